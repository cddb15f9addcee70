"""Duplicates of a stream on one key, remembered for a bounded time.

Spark's state holds each key for ``horizon`` behind the greatest time seen; so it is bounded by
what arrives in that time, not by the stream. A row whose key was let through within the
horizon is dropped. One that comes after its key was forgotten is let through again: who can't
have that looks it up in the stored table as well (``collect_news``). A row that is older than
the horizon when it arrives is dropped, whatever its key. Null and empty keys never meet and
are never late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_within(stream: DataFrame, key: Column, at: str, horizon: str) -> DataFrame:
    """The stream's columns; of rows with one key inside the horizon the first to arrive."""
    keyed = stream.withColumn("_key", F.nullif(key.cast("string"), F.lit("")))
    once = keyed.filter("_key IS NOT NULL").withWatermark(at, horizon).dropDuplicatesWithinWatermark(["_key"])
    return once.drop("_key").union(keyed.filter("_key IS NULL").drop("_key"))
