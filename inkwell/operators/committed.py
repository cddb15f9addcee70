"""Tables in buckets whose versions are committed by a manifest: append, upsert, update, delete.

A row's bucket is a hash of its key. A commit writes new folders for the buckets it touches,
no others, and then a manifest that says which folders make up each bucket; a reader takes the
newest manifest and so sees one version, whatever is written meanwhile, until ``vacuumed``
removes what older versions alone use. A manifest's name carries its version and is renamed
into place only if it isn't there: of two writers that started from one version, the second gets a
``Conflict`` and may try again. A job that dies leaves folders that no manifest names.

Cases: null keys share a bucket, and are rows of their own to an upsert, as in SQL; a commit
without rows makes a version with the same rows; of rows with one key in one upsert the one of
the greatest version stays, a null version last; a condition that gives null counts as false.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import store

BUCKETS, RUNS = 64, 8


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class Manifest(NamedTuple):
    """Which folders make up each bucket of a version, and how rows are dealt."""

    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[int, list[str]]


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    folder, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def removed(spark: SparkSession, path: str) -> None:
    folder, fs = _files(spark, path)
    fs.delete(folder, True)


def _publish(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """The manifest appears whole or not at all: it is written aside and renamed, which fails if the name is taken."""
    file, fs = _files(spark, f"{path}/manifests/{m.version:09d}.json")
    draft, _ = _files(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(m._asdict()).encode())
    out.close()
    fs.mkdirs(file.getParent())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, file, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise Conflict(f"version {m.version} of {path} is taken") from e
    return m


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version."""
    found = names(spark, f"{path}/manifests")
    name = found[-1] if version is None else f"{version:09d}.json"
    if name not in found:
        raise ValueError(f"{path} has no version {version}")
    file, fs = _files(spark, f"{path}/manifests/{name}")
    source = fs.open(file)
    raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    m = Manifest(**json.loads(raw))
    return m._replace(folders={int(b): f for b, f in m.folders.items()})


def create(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> Manifest:
    """An empty table, if there is none; else what there is."""
    if names(spark, f"{path}/manifests"):
        return manifest(spark, path)
    try:
        return _publish(spark, path, Manifest(0, key, buckets, schema.json(), {}))
    except Conflict:
        return manifest(spark, path)


def bucket(m: Manifest, key: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.col(m.key) if key is None else key), F.lit(m.buckets)).cast("int")


def rows(spark: SparkSession, path: str, m: Manifest, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, or those of some of its buckets alone; other folders aren't looked at."""
    schema = T.StructType.fromJson(json.loads(m.schema))
    folders = [f"{path}/data/{f}" for b in sorted(m.folders) if only is None or b in set(only) for f in m.folders[b]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return rows(spark, path, manifest(spark, path, version))


def touched(m: Manifest, keys: DataFrame, key: str | None = None) -> list[int]:
    """The buckets of these keys: at most as many numbers as the table has buckets."""
    return sorted(r[0] for r in keys.select(bucket(m, F.col(key or m.key)).alias("b")).distinct().collect())


def _written(spark: SparkSession, path: str, m: Manifest, df: DataFrame) -> dict[int, str]:
    """Write rows by bucket under a new name; the folder of each bucket that got rows."""
    name = f"{m.version + 1:09d}-{uuid.uuid4().hex[:12]}"
    columns = [f.name for f in T.StructType.fromJson(json.loads(m.schema))]
    dealt = df.select(*columns, bucket(m).alias("_bucket")).repartition("_bucket")
    dealt.write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    found = [n for n in names(spark, f"{path}/data/{name}") if n.startswith("_bucket=")]
    return {int(n.split("=")[1]): f"{name}/{n}" for n in found}


def _replaced(spark: SparkSession, path: str, m: Manifest, df: DataFrame, gone: list[int]) -> Manifest:
    """Commit ``df`` as all rows of the buckets in ``gone``."""
    new = _written(spark, path, m, df)
    folders = {b: f for b, f in m.folders.items() if b not in set(gone)} | {b: [f] for b, f in new.items()}
    return _publish(spark, path, m._replace(version=m.version + 1, folders=folders))


def append(spark: SparkSession, path: str, new: DataFrame, runs: int = RUNS) -> Manifest:
    """Commit further rows; a bucket that comes to more than ``runs`` folders is rewritten as one."""
    m = manifest(spark, path)
    folders = {b: list(f) for b, f in m.folders.items()}
    for b, f in _written(spark, path, m, new).items():
        folders.setdefault(b, []).append(f)
    m = _publish(spark, path, m._replace(version=m.version + 1, folders=folders))
    full = [b for b, f in folders.items() if len(f) > runs]
    return _replaced(spark, path, m, rows(spark, path, m, full), full) if full else m


def upsert(spark: SparkSession, path: str, new: DataFrame, version: str) -> Manifest:
    """Commit the row of the greatest version of each key, new or stored; only buckets of new keys are read and written."""
    m = manifest(spark, path)
    some = touched(m, new)
    old, columns = rows(spark, path, m, some), [f.name for f in T.StructType.fromJson(json.loads(m.schema))]
    no_key = F.col(m.key).isNull()
    merged = store.upsert(old.filter(~no_key), new.select(*columns).filter(~no_key), m.key, version)
    kept = merged.unionByName(old.filter(no_key)).unionByName(new.select(*columns).filter(no_key))
    return _replaced(spark, path, m, kept, some)


def delete(spark: SparkSession, path: str, where: Column, keys: DataFrame | None = None) -> Manifest:
    """Commit without the rows where the condition holds; with ``keys``, only rows of these keys are looked at."""
    m = manifest(spark, path)
    some = sorted(m.folders) if keys is None else touched(m, keys)
    held = rows(spark, path, m, some)
    hit = F.coalesce(where, F.lit(False))
    if keys is not None:
        listed = keys.select(F.col(m.key).alias("_key")).distinct().withColumn("_listed", F.lit(True))
        held = held.join(listed, held[m.key] == F.col("_key"), "left").withColumn("_hit", hit & F.col("_listed").isNotNull())
    else:
        held = held.withColumn("_hit", hit)
    changed = [b for b in touched(m, held.filter("_hit")) if b in m.folders]
    kept = held.filter(~F.col("_hit") & bucket(m).isin(changed)).select(*rows(spark, path, m, []).columns)
    return _replaced(spark, path, m, kept, changed)


def update(spark: SparkSession, path: str, where: Column, values: dict[str, Column]) -> Manifest:
    """Commit new values where the condition holds; a key may not be updated, and only buckets with such rows are rewritten."""
    m = manifest(spark, path)
    if m.key in values:
        raise ValueError("a key can't be updated")
    changed = touched(m, rows(spark, path, m).filter(F.coalesce(where, F.lit(False))))
    held = rows(spark, path, m, changed)
    return _replaced(spark, path, m, store.updated(held, where, values), changed)


def vacuumed(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove manifests but the newest ``keep``, and folders that those don't name; no commit may be under way."""
    found = names(spark, f"{path}/manifests")
    for name in found[:-keep]:
        removed(spark, f"{path}/manifests/{name}")
    used = {f for name in found[-keep:] for fs in manifest(spark, path, int(name.split(".")[0])).folders.values() for f in fs}
    out = []
    for commit in names(spark, f"{path}/data"):
        parts = [n for n in names(spark, f"{path}/data/{commit}") if n.startswith("_bucket=")]
        unused = [n for n in parts if f"{commit}/{n}" not in used]
        for n in unused if len(unused) < len(parts) else [""]:
            removed(spark, f"{path}/data/{commit}/{n}")
        out += [f"{commit}/{n}" for n in unused]
    return out
