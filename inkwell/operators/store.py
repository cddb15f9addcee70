"""Tables over Parquet snapshots: listing orders, append, upsert, patch, delete, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.dedup import written

#: The listing order of each table: (column, descending).
LISTING = {
    "news": (("published_at", True), ("id", True)),
    "videos": (("is_hot", True), ("collected_at", True), ("id", True)),
    "creators": (("enabled", True), ("updated_at", True), ("id", True)),
    "materials": (("id", True),), "tasks": (("id", True),), "contents": (("id", True),),
    "sources": (("id", False),), "profiles": (("id", False),),
}


def listed(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in LISTING[name]])


def with_new_ids(new: DataFrame, stored: DataFrame, order: list[Column], id_: str = "id", buckets: int = 64) -> DataFrame:
    """``new`` with ids that follow the stored ones, in a fixed order.

    Numbers come from a range partitioning: rows are counted by partition, and each
    partition numbers its own, so that no task holds them all. The ranges are drawn from a
    sample, anew in each job, so the partitioned rows are written once and counted and
    numbered from there.
    """
    top = stored.agg(F.coalesce(F.max(id_), F.lit(0)).cast("long").alias("_top")).first()["_top"]
    parted = written(new.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranked = parted.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # at most ``buckets`` rows
    return ranked.join(F.broadcast(offsets), "_part").withColumn(id_, F.col("_in") + F.col("_before") + F.lit(top)).drop("_part", "_in", "_before")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_new")


def patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null values of the patch replace, null ones keep."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = base.join(p, key, "left")
    return out.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in columns else c for c in base.columns])


def seeded(stored: DataFrame, seeds: DataFrame, name: str = "name", case_insensitive: bool = False) -> DataFrame:
    """The stored rows and those seeds whose name is not stored."""
    fold = (lambda c: F.lower(F.trim(c))) if case_insensitive else F.trim
    known = stored.select(fold(F.col(name)).alias("_name")).distinct()
    return stored.unionByName(seeds.join(known, fold(F.col(name)) == F.col("_name"), "left_anti"))


def validated(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``errors``: the names of the checks that a row fails (null counts as failing)."""
    return df.withColumn("errors", F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, ok in checks.items()]), lambda e: e.isNotNull()))


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in any of the columns, nulls being equal."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.join(o, key).filter(~same).select(*new.columns)


def with_known(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Add ``known``: whether the stored table has the row's key."""
    hit = stored.select(key).distinct().withColumn("known", F.lit(True))
    return rows.join(hit, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the condition holds (null counts as not)."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, where: Column, keys: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows without those where the condition holds and those whose key is listed."""
    out = rows.filter(~F.coalesce(where, F.lit(False)))
    return out if keys is None else out.join(keys.select(key), key, "left_anti").select(*rows.columns)


def with_default(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """A column added with a default, or filled with it where it is there and null."""
    return rows.withColumn(column, F.coalesce(column, value) if column in rows.columns else value)


def export_snapshot(entities: dict[str, DataFrame], path: str, exported_at: str, version: int = 1) -> None:
    """One JSON folder an entity, and a manifest."""
    spark = next(iter(entities.values())).sparkSession
    for name, df in entities.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    rows = [(version, exported_at, sorted(entities))]
    spark.createDataFrame(rows, "version int, exportedAt string, entities array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_snapshot(spark, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The entities of a snapshot; a ValueError if one is missing or a row doesn't parse."""
    found = spark.read.schema("version int, exportedAt string, entities array<string>").json(f"{path}/manifest").first()
    if found is None or set(schemas) - set(found["entities"]):
        raise ValueError("the snapshot lacks an entity")
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/{name}")
        # Spark can't filter the raw JSON by this column alone, so all of a row is read.
        bad = df.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("bad"), *[F.count(c) for c in df.columns if c != "_corrupt"])
        if bad.first()["bad"]:
            raise ValueError(f"the snapshot's {name} don't parse")
        out[name] = df.drop("_corrupt")
    return out


def parse_snapshot(documents: DataFrame, column: str = "document") -> DataFrame:
    """One-document snapshots: add ``valid`` (all four members are arrays) and the members' sizes."""
    members = ("sources", "tasks", "materials", "drafts")
    size = {f"n_{m}": F.json_array_length(F.get_json_object(column, f"$.{m}")) for m in members}
    return documents.withColumn("valid", whole_document(F.col(column), members)).withColumns(size)


def export_documents(entities: dict[str, DataFrame], key: str, exported_at: str, version: int = 1) -> DataFrame:
    """(key, document): one JSON document a workspace, with its version, time and each entity's rows in order; a null key is a workspace too."""
    rows = None
    for name, df in entities.items():
        fields = F.struct(*[c for c in df.columns if c != key])
        part = df.select(F.col(key).alias("_key"), F.lit(name).alias("_name"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("_row"))
        rows = part if rows is None else rows.union(part)
    kept = [F.array_sort(F.collect_list(F.when(F.col("_name") == n, F.col("_row")))).alias(n) for n in entities]
    grouped = rows.groupBy("_key").agg(*kept)
    arrays = [F.concat(F.lit(f'"{n}":['), F.array_join(n, ","), F.lit("]")) for n in entities]
    head = F.lit(f'{{"version":{version},"exportedAt":"{exported_at}"')
    return grouped.select(F.col("_key").alias(key), F.concat(F.concat_ws(",", head, *arrays), F.lit("}")).alias("document"))


def import_documents(documents: DataFrame, key: str, schemas: dict[str, str], column: str = "document") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each entity's rows with their workspace's key, and the keys of documents that aren't whole: no JSON, or a member that is no array."""
    members = ", ".join(f"`{n}`: ARRAY<STRUCT<{s}>>" for n, s in schemas.items())
    parsed = documents.withColumn("_ok", whole_document(F.col(column), tuple(schemas)))
    doc = F.from_json(F.when(F.col("_ok"), F.col(column)), f"STRUCT<{members}>")
    good = parsed.filter("_ok").select(key, doc.alias("_doc"))
    out = {n: good.select(key, F.explode(F.col(f"_doc.`{n}`")).alias("_row")).select(key, "_row.*") for n in schemas}
    return out, parsed.filter("NOT _ok").select(key)


def whole_document(document: Column, members: tuple[str, ...]) -> Column:
    ok = F.try_parse_json(document).isNotNull()
    for m in members:
        ok = ok & F.coalesce(F.get_json_object(document, f"$.{m}").startswith("["), F.lit(False))
    return F.coalesce(ok, F.lit(False))
