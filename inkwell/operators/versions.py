"""Versions of documents: every change kept with the interval in which it held.

A history has a row a change: its key, time, a number that orders changes of one time, its
columns, and ``valid_to``, the time of the key's next change (null for the last). Merging later
or late changes rebuilds the intervals of their keys alone, and gives what all changes at once
would have given. A key's next row is found in two steps, inside a span of time and then
from span to span, so that a key with very many changes is no single task.

Cases: rows without key or time are no changes; of changes with one key, time and number one
is kept, the greatest; a change whose ``gone`` column is true ends the document; a text that
is set again to what it was is a version of its own until ``condensed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "month"


def beside(rows: DataFrame, key: str, order: list[str], span: Column, value: Column, after: bool) -> Column | DataFrame:
    """Add ``_beside``: ``value`` of the key's next row in order (or of the one before), null at the end."""
    sign = (lambda c: F.col(c).asc()) if after else (lambda c: F.col(c).desc())
    rows = rows.withColumn("_span", span).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(key, "_span").orderBy(*[sign(c) for c in order])
    rows = rows.withColumn("_beside", F.lead("_value").over(inside))
    edge = F.struct(*order)
    pick = F.min_by if after else F.max_by
    ends = rows.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_of")).agg(pick("_value", edge).alias("_end"))
    spans = Window.partitionBy("_key").orderBy(sign("_of"))  # a row a span, not a row a change
    ends = ends.select("_key", "_of", F.lead("_end").over(spans).alias("_far"))
    rows = rows.join(ends, (rows[key] == ends["_key"]) & (rows["_span"] == ends["_of"]), "left")
    return rows.withColumn("_beside", F.coalesce("_beside", "_far")["v"]).drop("_span", "_value", "_key", "_of", "_far")


def history(changes: DataFrame, key: str, at: str, number: str, span: str = SPAN) -> DataFrame:
    """All changes with ``valid_to``."""
    good = changes.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    others = [c for c in good.columns if c not in (key, at, number)]
    one = good.groupBy(key, at, number).agg(F.max(F.struct(*others)).alias("_one")) if others else good.distinct()
    one = one.select(key, at, number, *[F.col(f"_one.{c}").alias(c) for c in others])
    return beside(one, key, [at, number], F.date_trunc(span, F.col(at)), F.col(at), after=True).withColumnRenamed("_beside", "valid_to")


def merged(old: DataFrame, changes: DataFrame, key: str, at: str, number: str, span: str = SPAN) -> DataFrame:
    """The history after further changes, late ones too; keys without any keep their rows as they are."""
    some = changes.select(F.col(key).alias("_touched")).filter("_touched IS NOT NULL").distinct()
    hit = F.col(key) == F.col("_touched")
    rebuilt = history(old.join(some, hit, "left_semi").drop("valid_to").unionByName(changes), key, at, number, span)
    return old.join(some, hit, "left_anti").unionByName(rebuilt)


def as_of(held: DataFrame, at: str, time: Column, gone: str | None = None) -> DataFrame:
    """Each document's row that held at a time; none of one that had ended or not begun."""
    alive = ~F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(True)
    return held.filter((F.col(at) <= time) & (F.col("valid_to").isNull() | (F.col("valid_to") > time)) & alive)


def condensed(held: DataFrame, key: str, at: str, number: str, columns: list[str], span: str = SPAN) -> DataFrame:
    """Versions with equal columns that follow each other as one, from the first's time to the last's ``valid_to``."""
    content = F.xxhash64(*[F.to_json(F.struct(c)) for c in columns])
    rows = beside(held, key, [at, number], F.date_trunc(span, F.col(at)), content, after=False)
    starts = rows.filter(F.col("_beside").isNull() | (F.col("_beside") != content)).drop("_beside", "valid_to")
    return history(starts, key, at, number, span)
