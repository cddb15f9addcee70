"""Cycles of a stream that fail without ending it, and keys of stored rows by bucket.

A cycle is one micro-batch. If its work raises, what it half wrote is removed, its rows are
kept in ``-failed`` beside the table, and the log gets a row of status ``failed`` with the
error; the stream goes on. Each later cycle first does its own work and then tries the kept
ones again, one by one, so that a batch that can't be stored holds up no other; one that
succeeds is logged as a further attempt and its kept rows go. After ``most`` attempts it is left
for somebody to look at (``failed_rows``). Rows that can't even be kept, as when their source
can't be read, end the query: nothing is marked as done that isn't stored or kept.

Every attempt writes folders of its own batch id, so a cycle that a lost driver cut off is
done again and replaces its own traces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import committed
from inkwell.operators.dedup import removed_after

ATTEMPTS, KEY_BUCKETS, TIDY = 5, 64, 16
KEYS = T.StructType().add("kind", T.StringType()).add("key", T.StringType()).add("batch", T.LongType())


def failed_batches(spark: SparkSession, table_path: str) -> list[int]:
    """Ids of kept batches, in order."""
    return sorted(int(n.split("=")[1]) for n in committed.names(spark, f"{table_path}-failed") if n.startswith("batch="))


def failed_rows(spark: SparkSession, table_path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{table_path}-failed/batch={batch_id}")


def attempts(spark: SparkSession, log_path: str, batch_id: int) -> int:
    return sum(n.startswith("attempt=") for n in committed.names(spark, f"{log_path}/batch={batch_id}"))


def logged(summary: DataFrame, log_path: str, batch_id: int, attempt: int) -> None:
    """Write one run's row: its counts, status, message and when it ended."""
    summary.withColumn("finished_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}/attempt={attempt}")


def run_log(spark: SparkSession, log_path: str) -> DataFrame:
    """All runs, failed ones too, with their batch and attempt."""
    return spark.read.option("mergeSchema", "true").parquet(log_path)


def isolated(work: Callable[[DataFrame, int], tuple[DataFrame, Callable[[], None]]], table_path: str, log_path: str, outputs: list[str], most: int = ATTEMPTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function around ``work``, which stores a batch and returns its summary of one row and a last step.

    The last step, which lets other batches know of this one's rows, follows the log. ``outputs`` are tables in which a batch writes a folder of its own id, removed if it fails.
    """

    def attempt(rows: DataFrame, batch_id: int, number: int) -> Exception | None:
        spark = rows.sparkSession
        try:
            with removed_after(spark):
                summary, last = work(rows, batch_id)
                logged(summary, log_path, batch_id, number)
                last()
        except Exception as e:  # noqa: BLE001 - whatever a cycle raises is logged, and the next one runs
            for path in outputs:
                committed.removed(spark, f"{path}/batch={batch_id}")
            return e
        return None

    def note(spark: SparkSession, batch_id: int, number: int, discovered: int, error: Exception) -> None:
        message = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500]
        row = [(discovered, 0, 0, "failed", message)]
        logged(spark.createDataFrame(row, "discovered long, created long, duplicate_skipped long, status string, message string").coalesce(1), log_path, batch_id, number)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = [b for b in failed_batches(spark, table_path) if b != batch_id]
        committed.removed(spark, f"{table_path}-failed/batch={batch_id}")  # of a cycle that was cut off
        committed.removed(spark, f"{log_path}/batch={batch_id}")
        if error := attempt(batch, batch_id, 1):
            kept = f"{table_path}-failed/batch={batch_id}"
            batch.write.mode("overwrite").parquet(kept)
            note(spark, batch_id, 1, spark.read.schema(batch.schema).parquet(kept).count(), error)
        for old in waiting:
            number = attempts(spark, log_path, old) + 1
            if number > most:
                continue
            rows = failed_rows(spark, table_path, old, batch.schema)
            if error := attempt(rows, old, number):
                note(spark, old, number, rows.count(), error)
            else:
                committed.removed(spark, f"{table_path}-failed/batch={old}")

    return run


# --- Keys of stored rows --------------------------------------------------------------------------


class StoredKeys:
    """Keys that a table holds, by kind, in buckets: a batch reads the buckets of its own keys alone."""

    def __init__(self, spark: SparkSession, table_path: str, buckets: int = KEY_BUCKETS):
        self.spark, self.path = spark, f"{table_path}-keys"
        committed.create(spark, self.path, KEYS, "key", buckets)

    def near(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """(kind, key, batch) in the buckets of ``keys``, but what this batch wrote itself in an earlier attempt."""
        m = committed.manifest(self.spark, self.path)
        return committed.rows(self.spark, self.path, m, committed.touched(m, keys)).filter(F.col("batch") != batch_id)

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Commit (kind, key) pairs; empty and null keys are none."""
        new = keys.filter("key IS NOT NULL AND key <> ''").select("kind", "key", F.lit(batch_id).cast("long").alias("batch"))
        m = committed.append(self.spark, self.path, new)
        if m.version % TIDY == 0:  # only the stream reads this table, so old versions may go
            committed.vacuumed(self.spark, self.path, keep=2)

    def filled(self, stored: Callable[[], DataFrame], kinds: dict[str, str]) -> None:
        """Index, once, what a table held before it had an index."""
        if committed.manifest(self.spark, self.path).version == 0:
            committed.append(self.spark, self.path, pairs(stored(), kinds, "batch").filter("key IS NOT NULL AND key <> ''"))


def pairs(rows: DataFrame, kinds: dict[str, str], *also: str) -> DataFrame:
    """(kind, key) of all rows, and further columns; ``kinds`` names the column that holds each kind."""
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in kinds.items()]))
    return rows.select(made.alias("x"), *also).select("x.*", *also)

