"""Proportional stratified interleaving: every shard is a small copy of the mixture.

Rows are shuffled by a seeded hash within their source and ranked; rank r of n rows gets the
fraction (r - 1/2) / n. Sorted by that fraction the sources interleave in proportion, and
equal cuts of the sorted order give shards whose row counts differ by one at most.

Neither rank is taken in one task per source. Both orders are cut into many fine buckets of
their sort key: rows are numbered inside a bucket, and each bucket's offset comes from
the counts of those ahead in its block of buckets, and of the blocks ahead: a task sums at
most BUCKETS_A_BLOCK rows of the one, and one row of the other for four million rows. A source with a third of all rows thus spreads over
as many buckets as its rows need.

Cases: a null source is a stratum of its own; a null text is empty (size 1); rows of equal
id and text take any order among themselves and so give the same result; an empty table
gives no rows; helper columns start with ``_shard_``. Law: ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, table

SHARDS, SEED, ROWS_A_BUCKET, BUCKETS_A_BLOCK = 8, 17, 1000, 4096


def _numbered(df: DataFrame, strata: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the 1-based rank in (bucket, order) within the strata."""
    keys = [*strata, bucket]
    df = df.withColumn(f"{name}_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    counts = df.groupBy(*keys).agg(F.count("*").alias(f"{name}_n")).withColumn(f"{name}_block", F.floor(F.col(bucket) / BUCKETS_A_BLOCK))
    ahead = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*strata, f"{name}_block").agg(F.sum(f"{name}_n").alias(f"{name}_sum"))
    blocks = blocks.withColumn(f"{name}_ahead", F.coalesce(F.sum(f"{name}_sum").over(ahead(*strata).orderBy(f"{name}_block")), F.lit(0))).drop(f"{name}_sum")
    inside = F.coalesce(F.sum(f"{name}_n").over(ahead(*strata, f"{name}_block").orderBy(bucket)), F.lit(0))
    counts = counts.withColumn(f"{name}_inside", inside).join(blocks, [*strata, f"{name}_block"])
    counts = counts.select(*keys, (F.col(f"{name}_inside") + F.col(f"{name}_ahead")).alias(f"{name}_before"))
    counts = counts.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], f"{name}_before")
    same = [df[k].eqNullSafe(counts[f"{name}_{k}"]) for k in keys]
    out = df.join(counts, same, "left")
    return out.withColumn(name, F.col(f"{name}_in") + F.col(f"{name}_before")).drop(f"{name}_in", f"{name}_before", *[f"{name}_{k}" for k in keys])


def interleave(rows: DataFrame, identity: list[Column], source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``. ``identity``: what tells rows apart, as columns cast to text.

    The shuffle key is md5(seed and identity), so the order depends on nothing but the rows.
    ``rows`` is read twice (once for the counts of sources): keep wide columns out of it.
    """
    total = rows.count()
    buckets = max(1, -(-total // ROWS_A_BUCKET))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in identity]))
    df = rows.withColumn("_shard_key", key).withColumn("_shard_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    spread = F.conv(F.substring("_shard_key", 1, 8), 16, 10).cast("long")
    df = df.withColumn("_shard_bucket", F.floor(spread * buckets / (1 << 32)).cast("long"))
    sizes = rows.groupBy(F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_shard_source")).agg(F.count("*").alias("_shard_of"))
    df = _numbered(df, ["_shard_source"], "_shard_bucket", [F.col("_shard_key"), *identity], "_shard_rank")
    df = df.join(sizes, "_shard_source", "left")
    df = df.withColumn("_shard_at", (F.col("_shard_rank") - F.lit(0.5)) / F.col("_shard_of"))
    df = df.withColumn("_shard_bucket", F.floor(F.col("_shard_at") * buckets).cast("long")).withColumn("_shard_all", F.lit(0))
    df = _numbered(df, ["_shard_all"], "_shard_bucket", [F.col("_shard_at"), F.col("_shard_source"), F.col("_shard_rank")], "_shard_row")
    place = F.col("_shard_row") - 1
    # Rows with floor(p * shards / total) = s begin at ceil(s * total / shards).
    df = df.withColumn("shard", F.expr(f"cast((_shard_row - 1) * {shards} div {max(total, 1)} as int)"))
    begin = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    df = df.withColumn("slot", place - begin)
    return df.drop(*[c for c in df.columns if c.startswith("_shard_")])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id", "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    thin = materialize(thin, "thin")
    out = interleave(thin, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 byte by byte, with its table made by eight halvings of each byte.
_HALVE = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLE = f"""WITH RECURSIVE s(b, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, {_HALVE}, k + 1 FROM s WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM s WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
e AS (SELECT doc_id, source, size, hex(encode(t)) AS x FROM d),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(0, CAST(len(x) / 2 AS BIGINT)), lambda i: CAST(instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17 AS BIGINT))),
    lambda a, y: xor(a >> 8, tab.t[(xor(a, y) & 255) + 1])), 4294967295) AS crc FROM e, tab),
k AS (SELECT doc_id, size, crc, coalesce('=' || source, '') AS src,
    md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(crc AS VARCHAR), CAST(size AS VARCHAR))) AS key FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY key, doc_id, crc, size) AS rnk, count(*) OVER (PARTITION BY src) AS n FROM k),
g AS (SELECT *, row_number() OVER (ORDER BY (rnk - 0.5::DOUBLE) / n, src, rnk) - 1 AS p, count(*) OVER () AS total FROM r),
z AS (SELECT *, p * {SHARDS} // total AS sh FROM g)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(sh AS INT) AS shard, CAST(p - (sh * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM z"""
