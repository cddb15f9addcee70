"""Nearest neighbours by cosine: an index of lists, searched list by list in blocks.

An index holds every distinct vector once, with its least ids, in the list of its nearest
centroid. Centroids are fitted on a bounded sample (``SAMPLE`` vectors, those whose ids hash
lowest); how many lists a query has to probe is measured on that sample as well, so that
``RECALL`` of the true neighbours lie in them: few on data with clusters, most on data without.
With a single list, or when all are probed, a search is exact.

A list is split into blocks of about ``BLOCK`` vectors. A query travels to every block of the
lists it probes, never to rows: a task holds one block as a matrix while the queries that want
it stream past, and each gives its best few of that block. What a query gets back grows with
the number of blocks, and is cut to the best few before it is shuffled. A vector that very
many rows share is one row of the index and one query.

Cases: a vector that is null, empty, all zeros or holds a null, NaN or infinity is neither
indexed nor answered; vectors meet only those of the same length; a null id is not indexed;
equal similarities (to nine decimals) come by id; a row isn't its own neighbour; a query with
fewer than ``k`` others gets those; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.operators.dedup import first_per_group, written
from inkwell.operators.workers import ship

SAMPLE, LISTS, BLOCK, MOST, RECALL, ROUNDS, SEED = 20_000, 256, 4096, 100, 0.96, 12, 11
#: Queries multiplied with a block at once.
AT_ONCE = 256


class Index(NamedTuple):
    """A written index: its vectors, centroids (lists x dimension) for each vector length, lists to probe and blocks of each list."""

    stored: DataFrame
    centroids: dict[int, np.ndarray]
    probes: dict[int, int]
    blocks: DataFrame


def usable(rows: DataFrame, vector: str) -> Column:
    v = F.col(vector)
    plain = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & plain & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(values: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long vectors as a matrix of unit rows."""
    m = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_means(m: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of unit rows; a list that loses its last row is placed on another row."""
    rng = np.random.default_rng(seed)
    c = m[rng.permutation(len(m))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([(m[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(m), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        norm = np.linalg.norm(sums, axis=1)
        lost = norm < 1e-12
        sums[lost] = m[rng.integers(0, len(m), int(lost.sum()))]
        norm[lost] = 1
        c = sums / norm[:, None]
    return c


def needed_probes(m: np.ndarray, c: np.ndarray, k: int, recall: float, asked: int = 200) -> int:
    """The least number of lists that hold ``recall`` of the sample's own neighbours."""
    q = m[:: max(1, len(m) // asked)]
    near = np.concatenate([(m[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(m), 4096)])
    best = np.argsort(-(q @ m.T), axis=1)[:, 1 : k + 1]
    order = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    ranks = np.take_along_axis(order, near[best], axis=1).ravel()
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks.size else len(c)


def distinct_vectors(rows: DataFrame, id_: str, vector: str, most: int) -> DataFrame:
    """(vec, ids): each vector once, with its ``most`` least ids; copies are cut to those before the shuffle."""
    good = rows.filter(usable(rows, vector) & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("vec"))
    return first_per_group(good, ["vec"], [F.col("id")], most).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def fitted(vectors: DataFrame, lists: int, sample: int, k: int, recall: float) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Centroids and probes for each length, from at most ``sample`` vectors, the same ones at each run."""
    if lists == 1:
        return {}, {}
    taken = vectors.orderBy(F.xxhash64(F.element_at("ids", 1)), F.element_at("ids", 1)).limit(sample).select("vec").toArrow()["vec"].combine_chunks()
    centroids, probes = {}, {}
    size = np.array([len(v) for v in taken], int)
    for dim in sorted(set(size.tolist())):
        m = unit(taken.filter(pa.array(size == dim)), dim)
        c = spherical_means(m, max(1, min(lists, len(m) // 8)))
        centroids[dim], probes[dim] = c, needed_probes(m, c, k, recall)
    return centroids, probes


def with_lists(rows: DataFrame, centroids: dict[int, np.ndarray], probes: dict[int, int]) -> DataFrame:
    """Add ``lists``: the ``probes`` nearest lists of ``vec``; a length without centroids has list 0 alone."""
    at = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                g = b.slice(i, 2048)
                size = np.array([len(v) for v in g.column(at)], int)
                out: list = [[0]] * g.num_rows
                for dim in set(size.tolist()) & set(centroids):
                    where = np.flatnonzero(size == dim)
                    near = -(unit(g.column(at).take(pa.array(where)), dim) @ centroids[dim].T)
                    n = min(probes[dim], near.shape[1])
                    for k, x in zip(where, np.argsort(near, axis=1, kind="stable")[:, :n].tolist(), strict=True):
                        out[k] = x
                yield pa.RecordBatch.from_arrays([*g.columns, pa.array(out, pa.list_(pa.int32()))], [*g.schema.names, "lists"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))


def build(rows: DataFrame, path: str, id_: str = "id", vector: str = "vector", lists: int = LISTS, sample: int = SAMPLE, k: int = 10, recall: float = RECALL, most: int = MOST, block: int = BLOCK) -> Index:
    """Index every usable row; searches of up to ``most - 1`` neighbours can be answered from it."""
    ship(rows.sparkSession)
    vectors = written(distinct_vectors(rows, id_, vector, most), "vectors")
    centroids, probes = fitted(vectors, lists, sample, k, recall)
    placed = with_lists(vectors, centroids, dict.fromkeys(centroids, 1))
    placed = written(placed.select("vec", "ids", F.size("vec").alias("dim"), F.col("lists")[0].alias("list")), "placed")
    blocks = placed.groupBy("dim", "list").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")  # at most ``lists`` rows a length
    split = placed.join(F.broadcast(blocks), ["dim", "list"])
    split = split.withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    split = split.select("vec", "ids", "dim", "block", "list").repartition("list", "block")
    split.write.mode("overwrite").partitionBy("list").parquet(path)
    return Index(rows.sparkSession.read.schema(split.schema).parquet(path), centroids, probes, blocks)


def _best(batches: Iterator[pa.RecordBatch], most: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each query its best ids of the block before it; a block's vectors precede its queries."""
    schema = pa.schema([("asker", id_type), ("sims", pa.list_(pa.float64())), ("found", pa.list_(id_type))])
    now, held, ids, matrix = None, [], [], None

    def answers(askers: list, q: np.ndarray) -> pa.RecordBatch:
        sims = np.round(q @ matrix.T, 9)
        keep = min(most, sims.shape[1])
        bound = np.partition(sims, sims.shape[1] - keep, axis=1)[:, sims.shape[1] - keep]
        out = []
        for asker, row, least in zip(askers, sims, bound, strict=True):
            some = sorted((-s, i) for j in np.flatnonzero(row >= least) for s in (row[j],) for i in ids[j][:most])[:most]
            out.append({"asker": asker, "sims": [-s for s, _ in some], "found": [i for _, i in some]})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for b in batches:
        places = list(zip(*[b.column(c).to_pylist() for c in ("dim", "list", "block", "asks")], strict=True))
        i = 0
        while i < b.num_rows:
            j = i + 1
            while j < b.num_rows and places[j] == places[i] and (not places[i][3] or j - i < AT_ONCE):
                j += 1
            part, place, dim = b.slice(i, j - i), places[i][:3], places[i][0]
            if place != now:
                now, held, ids, matrix = place, [], [], None
            if not places[i][3]:
                held.append(unit(part.column("vec"), dim))
                ids += part.column("ids").to_pylist()
            elif held:
                matrix = np.concatenate(held) if matrix is None else matrix
                yield answers(part.column("asker").to_pylist(), unit(part.column("vec"), dim))
            i = j


def search(spark: SparkSession, index: Index, queries: DataFrame, id_: str = "id", vector: str = "vector", k: int = 10, probes: int | None = None) -> DataFrame:
    """(id, rank, neighbour, similarity) of each query's ``k`` nearest other rows in the lists that it probes."""
    ship(spark)
    asking = queries.filter(usable(queries, vector) & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("vec"))
    asking = written(asking, "asking")
    distinct = asking.groupBy("vec").agg(F.min("id").alias("asker"))
    n = {d: probes or p for d, p in index.probes.items()}
    sent = with_lists(distinct, index.centroids, n).select("asker", "vec", F.size("vec").alias("dim"), F.explode("lists").alias("list"))
    sent = sent.join(F.broadcast(index.blocks), ["dim", "list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    stored = index.stored
    id_type = distinct.schema["asker"].dataType
    nothing = F.lit(None).cast(id_type)
    both = stored.select("dim", "list", "block", F.lit(False).alias("asks"), nothing.alias("asker"), "ids", "vec").union(
        sent.select("dim", "list", "block", F.lit(True), "asker", F.lit(None).cast(stored.schema["ids"].dataType), "vec"))
    both = both.repartition("dim", "list", "block").sortWithinPartitions("dim", "list", "block", "asks")
    arrow, kind = to_arrow_type(id_type), id_type.simpleString()
    parts = both.mapInArrow(lambda batches: _best(batches, k + 1, arrow), f"asker {kind}, sims array<double>, found array<{kind}>")
    each = parts.select("asker", F.explode(F.arrays_zip("sims", "found")).alias("x")).select("asker", F.col("x.sims").alias("sim"), F.col("x.found").alias("neighbour"))
    best = first_per_group(each, ["asker"], [F.col("sim").desc(), F.col("neighbour")], k + 1)
    best = best.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "neighbour"))).alias("best"))
    answered = asking.join(distinct, "vec").select("id", "asker").join(best, "asker")
    others = F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k)
    ranked = answered.select("id", F.posexplode(others).alias("pos", "x"))
    return ranked.select("id", (F.col("pos") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("similarity"))


def nearest(rows: DataFrame, queries: DataFrame, path: str, id_: str = "id", vector: str = "vector", k: int = 10) -> DataFrame:
    """The exact search: one list, all of whose blocks every query meets."""
    index = build(rows, path, id_, vector, lists=1, most=k + 1)
    return search(rows.sparkSession, index, queries, id_, vector, k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of true neighbours that were found; a neighbour as near as the last true one counts."""
    last = truth.groupBy("id").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
    hits = found.join(last, "id").filter(F.col("similarity") >= F.col("least")).groupBy("id", "n").agg(F.count("*").alias("hits"))
    total = truth.count()
    return (hits.agg(F.sum(F.least("hits", "n"))).first()[0] or 0) / total if total else 1.0
