"""Exact, order-sensitive removal of duplicates on two keys, and what a table already holds."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(df: DataFrame | SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only a local master may go without, in a temporary one."""
    context = getattr(df, "sparkSession", df).sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named := tempfile.mkdtemp(prefix="inkwell-"))
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextlib.contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside are removed at its end, so what it leaves must not read them: a stream's batch, a job that writes its result."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for each in stack.pop():
            path = context._jvm.org.apache.hadoop.fs.Path(each)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table_path(df: DataFrame | SparkSession, name: str) -> str:
    """A new path that goes with the innermost ``removed_after``, if there is one."""
    path = shared_path(df, name)
    if stack := _scopes.__dict__.get("stack"):
        stack[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and outlives executors."""
    df.write.parquet(path := table_path(df, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_wins(df: DataFrame, pos: str, key_a: Column, key_b: Column) -> DataFrame:
    """Rows kept by a walk in order of ``pos`` that drops a row if one of its keys was taken by a kept row.

    A dropped row takes nothing, and empty or null keys never meet. In each round, rows that
    are first in both their groups are kept and what shares a key with them is dropped; both
    are partial minima and joins over (pos, key, key) alone, so bodies of rows stay where
    they are and a very common key is no hot task. The number of rounds is half the length
    of the longest chain of conflicts; each round is written to the shared folder, where only
    the places of kept rows stay.
    """
    spark, path = df.sparkSession, table_path(df, "winners")
    with removed_after(spark):
        won = _winners(df.select(F.col(pos).alias("p"), F.nullif(key_a.cast("string"), F.lit("")).alias("a"), F.nullif(key_b.cast("string"), F.lit("")).alias("b")))
        won.write.parquet(path)
    winners = spark.read.schema(won.schema).parquet(path).withColumnRenamed("p", pos)
    return df.join(winners, pos, "left_semi").select(*df.columns)


def _winners(keys: DataFrame) -> DataFrame:
    """Places ``p`` of the rows that the walk keeps."""
    open_, kept = written(keys, "open"), [keys.select("p").limit(0)]

    def least(k: str) -> DataFrame:
        return open_.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("p").alias(f"first_{k}"))

    while not open_.isEmpty():
        ranked = open_.join(least("a"), "a", "left").join(least("b"), "b", "left")
        ranked = ranked.withColumn("keep", (F.coalesce("first_a", "p") == F.col("p")) & (F.coalesce("first_b", "p") == F.col("p")))
        ranked = written(ranked.select("p", "a", "b", "keep"), "round")
        won = ranked.filter("keep")
        kept.append(won.select("p"))
        rest = ranked.filter("NOT keep").select("p", "a", "b")
        for k in ("a", "b"):
            rest = rest.join(won.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        open_ = written(rest.select("p", "a", "b"), "open")
    return functools.reduce(DataFrame.union, kept)


def not_stored(new: DataFrame, stored: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``new`` none of whose keys the stored table has; ``keys``: the stored column for each key of a new row.

    One equi anti-join a key: an OR would become a nested loop. Empty keys never match.
    """
    for name, key in keys.items():
        known = stored.select(F.nullif(F.col(name).cast("string"), F.lit("")).alias(f"_st_{name}")).filter(F.col(f"_st_{name}").isNotNull()).distinct()
        new = new.withColumn("_key", F.nullif(key.cast("string"), F.lit("")))
        new = new.join(known, new["_key"] == known[f"_st_{name}"], "left_anti").drop("_key")
    return new


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only ``n`` a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def snapshot_diff(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose key the earlier snapshot lacks."""
    return now.join(before.select(key), key, "left_anti").select(*now.columns)
