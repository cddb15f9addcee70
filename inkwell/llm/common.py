"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.workers import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local master may go without, in a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named := tempfile.mkdtemp(prefix="inkwell-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With it, the files of a job's shuffles go when it ends, not when the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def append(df: DataFrame, path: str) -> None:
    """Write rows, to a table that may be there; shuffle files of the job go at its end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        conf.set(CLEAN_UP, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """Write a new table and read it back, which cuts the lineage."""
    append(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write(df, new_path(df.sparkSession, name))


class Scratch:
    """Written tables of one operator in the shared folder, removed as soon as nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it back; a name may come again, as in rounds."""
        path = new_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return write(df, path)

    def drop(self, *names: str) -> None:
        """Remove all tables written under these names."""
        context = self.spark.sparkContext
        for each in [p for name in names for p in self.paths.pop(name, [])]:
            path = context._jvm.org.apache.hadoop.fs.Path(each)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *kept: str) -> None:
        self.drop(*[name for name in self.paths if name not in kept])


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives freed memory back to the system at its end, as workers live on in other stages.

    The workers get this package first, whoever calls the operator.
    """
    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def text_of(column: str = "text") -> Column:
    """The text, with null read as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """Content address: rows of equal text share it, whatever their ids are."""
    return F.unhex(F.sha2(text_of(column), 256))
