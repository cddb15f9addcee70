"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weight = count x idf. Consistent
weighted samples of two texts agree with a probability equal to their weighted Jaccard
similarity; ``BANDS`` bands of ``ROWS`` samples bring similar texts into one bucket, and
each candidate pair is verified by its exact weighted Jaccard similarity, 0.8 or more.

idf is min(ln((N + 1) / df), ln(1 / RARE)), N and df counted over distinct texts: only
shingles in a share RARE of all texts or more have less than the greatest idf, and there are
at most (shingles a text) / RARE of them whatever the corpus. (An idf without that bound
would let one edited word outweigh ten shared ones in a large corpus.) They are found exactly: a table of counts of fixed size over all
shingles names the cells that may hold one, then only shingles of those cells are counted.

Exact copies collapse first; ids play no part until the end. In a bucket all texts are
verified against a centre, the one with the most companions over all its buckets (the
original among its copies). Those that fail meet again in the next round with a new centre,
ROUNDS times. Of a pair that no centre has connected, one text at least failed against its
bucket's first centre. So each text that failed in a first round is joined to all texts,
accepted ones included, that are not in its component yet, by rarest shingles (a prefix
filter, which misses no pair). Rare is what falls in a cell of few shingles; a fixed table
tells little of a corpus with far more shingles than cells. So a prefix shingle that more
than CROWD failed texts have brings no pairs by itself: all texts with such a shingle in
their prefix are joined once more among themselves, by prefixes in the order of how many of
them really hold each shingle. A similar pair shares either an uncrowded prefix shingle or
only crowded ones, and then both its texts are there. Links give components; one row a
document comes back with its class.

Cases: null and empty texts are copies of each other and like no other text; texts of one
to four words have one shingle; a null id never names a class unless all its rows' ids are
null; repeated rows (equal id and text) are one document and the kept table has it once;
an empty table gives no rows. Helper columns start with ``_near_``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, materialize, returning_memory, table, text_key, text_of
from inkwell.llm.graph import components
from inkwell.llm.shingles import MIX, mixed, shingle_hashes, slices_of, word_hashes

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, SEED = 12, 4, np.uint64(0xD1B54A32D192ED03)
RARE, CELLS, BLOCKS, ROUNDS, PIECE = 0.002, 1 << 22, 256, 3, 1 << 19
CROWD = 32


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def weighted_sets(texts: list[bytes], idf: tuple[np.ndarray, np.ndarray, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, text after text, their weights, and how many each has."""
    words, counts = word_hashes(texts)
    h, n = shingle_hashes(words, counts, SHINGLE)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h))).astype(np.float64)
    h, owner = h[at], owner[at]
    if idf is not None and len(h):
        known, value, most = idf
        k = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        tf *= np.where(known[k] == h, value[k], most) if len(known) else most
    return h, tf, np.bincount(owner, minlength=len(texts))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for b in batches:
        t = [x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()]
        for i, j in slices_of([len(x) for x in t], PIECE):
            yield t[i:j]


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[tuple[np.ndarray, np.ndarray, float], np.ndarray]:
    """Sorted shingles in a share RARE of all texts or more, their idf, and the idf of all others; and the bits that each cell's count has."""
    bodies = docs.select(text_of(text).alias("t"))
    total = docs.count()
    most, floor = float(np.log(1 / RARE)), RARE * (total + 1)
    block = CELLS // BLOCKS

    @returning_memory
    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for texts in _texts(batches):
            h, _, _ = weighted_sets(texts, None)
            c, n = np.unique(_cell(h), return_counts=True)
            cells[c] += n
        rows = [k for k in range(BLOCKS) if cells[k * block : (k + 1) * block].any()]
        used = [np.flatnonzero(cells[k * block : (k + 1) * block]) for k in rows]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(rows, pa.int32()),
            "at": pa.array([u.astype("<i4").tobytes() for u in used], pa.binary()),
            "n": pa.array([cells[k * block : (k + 1) * block][u].astype("<i8").tobytes() for k, u in zip(rows, used, strict=True)], pa.binary()),
        })

    @returning_memory
    def heavy_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                sums.setdefault(k, np.zeros(block, np.int64))[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        for k, s in sums.items():
            length = np.frexp(s.astype(np.float64))[1].astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(s >= floor).tobytes()], pa.binary()), "length": pa.array([length.tobytes()], pa.binary())})

    counts = bodies.mapInArrow(count_cells, "block int, at binary, n binary")
    heavy = counts.repartition(BLOCKS, "block").mapInArrow(heavy_cells, "block int, bits binary, length binary").collect()  # CELLS bits and bytes at most
    bits, lengths = np.zeros(CELLS, bool), np.zeros(CELLS, np.uint8)
    for row in heavy:
        bits[row["block"] * block : (row["block"] + 1) * block] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        lengths[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["length"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @returning_memory
    def count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(sent.value).astype(bool)
        for texts in _texts(batches):
            h, _, _ = weighted_sets(texts, None)
            h, n = np.unique(h[may[_cell(h)]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    exact = bodies.mapInArrow(count_shingles, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    rows = exact.toArrow()  # at most (shingles a text) / RARE rows of 16 bytes
    h = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
    df = rows["n"].to_numpy().astype(np.float64)
    order = np.argsort(h)
    return (h[order], np.minimum(np.log((total + 1) / df), most)[order].clip(1e-6), most), lengths


class Sampler:
    """Consistent weighted samples, by Ioffe's improved scheme.

    Each sample k gives an element the variates r and c ~ Gamma(2, 1) and beta ~ U(0, 1),
    all from a hash of (element, k); of t = floor(ln w / r + beta) and
    ln a = ln c - r (t - beta + 1), the element with the least a wins, with its t.
    Gamma variates come from tables of its quantiles, indexed by 16 bits of the hash.
    """

    def __init__(self) -> None:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.linspace(1e-4, 30, 1 << 18)
        cdf = 1 - np.exp(-x) * (1 + x)
        q = np.interp(u, cdf, x)
        self.seeds = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * SEED
        self.r, self.inverse, self.log_c = q.astype(np.float32), (1 / q).astype(np.float32), np.log(q).astype(np.float32)

    def bands(self, h: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        """BANDS hashes for each text; texts without shingles get no meaning from theirs."""
        texts = np.flatnonzero(n)
        out = np.zeros((len(n), BANDS), np.uint64)
        if not len(texts):
            return out
        sizes = n[texts]
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        log_w = np.log(w).astype(np.float32)
        sixteen = np.uint64(0xFFFF)
        for k in range(BANDS * ROWS):
            z = mixed(h ^ self.seeds[k])
            i = (z & sixteen).astype(np.int32)
            r, inverse = self.r[i], self.inverse[i]
            beta = ((z >> np.uint64(40)).astype(np.float32)) * np.float32(2**-24)
            t = np.floor(log_w * inverse + beta)
            a = self.log_c[((z >> np.uint64(16)) & sixteen).astype(np.int32)] - r * (t - beta + 1)
            hit = np.flatnonzero(a == np.minimum.reduceat(a, first)[owner])
            win = hit[np.unique(owner[hit], return_index=True)[1]]
            s = mixed(h[win] + t[win].astype(np.int64).view(np.uint64) * MIX)
            out[texts, k // ROWS] = out[texts, k // ROWS] * np.uint64(0x100000001B3) + s
        out[texts] = mixed(out[texts] + np.arange(1, BANDS + 1, dtype=np.uint64) * MIX)
        return out


def band_table(docs: DataFrame, idf, text: str = "text") -> DataFrame:
    """(_near_key, _near_bands) of every row; bands are null where a text has no words."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    rows = docs.select(text_of(text).alias("t"), text_key(text).alias("_near_key"))

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in batches:
            t = b.column(0).cast(pa.binary()).to_pylist()
            for i, j in slices_of([len(x) for x in t], PIECE):
                h, w, n = weighted_sets(t[i:j], sent.value)
                bands = sampler.bands(h, w, n).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "_near_key": b.column(1)[i:j],
                    "_near_bands": pa.array([x.tolist() if k else None for x, k in zip(bands, n, strict=True)], pa.list_(pa.int64())),
                })

    return rows.mapInArrow(run, "_near_key binary, _near_bands array<long>")


def verified(pairs: DataFrame, bodies: DataFrame, idf, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) of text keys with their weighted Jaccard similarity of ``least`` or more, and ``similarity``."""
    sent = pairs.sparkSession.sparkContext.broadcast(idf)
    both = pairs.join(bodies.select(F.col("_near_key").alias("b"), F.col("_near_text").alias("tb")), "b")
    both = both.join(bodies.select(F.col("_near_key").alias("a"), F.col("_near_text").alias("ta")), "a").select("a", "b", "ta", "tb")

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b, ta, tb = [batch.column(k).cast(pa.binary()).to_pylist() for k in range(4)]
            similarity = []
            for i in range(len(a)):
                if a[i] != last:  # rows come by centre
                    last, left = a[i], weighted_sets([ta[i]], sent.value)[:2]
                h, w, _ = weighted_sets([tb[i]], sent.value)
                at = np.minimum(np.searchsorted(left[0], h), max(len(left[0]) - 1, 0))
                same = left[0][at] == h if len(left[0]) else np.zeros(len(h), bool)
                least_sum = np.minimum(left[1][at[same]], w[same]).sum() if same.any() else 0.0
                total = left[1].sum() + w.sum() - least_sum
                similarity.append(float(least_sum / total) if total else 0.0)
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "similarity": pa.array(similarity, pa.float64())})

    return both.mapInArrow(run, "a binary, b binary, similarity double").filter(F.col("similarity") >= least - 1e-9)


def _prefixes(bodies: DataFrame, idf, lengths: np.ndarray, least: float) -> DataFrame:
    """(_near_key, band, rest, total): the rarest shingles of each text, up to 1 - ``least`` of its weight, the weight from each on and the text's.

    Two texts as similar as ``least`` share one of these: all are in one order (cells of few
    shingles first, then by hash), so what they share would else weigh less than ``least`` of one.
    """
    sent = bodies.sparkSession.sparkContext.broadcast((idf, lengths))

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, lengths = sent.value
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in slices_of([len(x) for x in texts], PIECE):
                h, w, n = weighted_sets(texts[i:j], idf)
                owner = np.repeat(np.arange(j - i), n)
                total = np.bincount(owner, w, j - i)
                order = np.lexsort((h, lengths[_cell(h)], owner))
                h, w = h[order], w[order]
                before = np.cumsum(w) - w
                rest = total[owner] - (before - np.repeat(before[(np.cumsum(n) - n)[n > 0]], n[n > 0]))
                k = np.flatnonzero(rest >= least * total[owner] * (1 - 1e-9))
                yield pa.RecordBatch.from_pydict({
                    "_near_key": b.column(0)[i:j].take(pa.array(owner[k])), "band": pa.array(h[k].view(np.int64)),
                    "rest": pa.array(rest[k]), "total": pa.array(total[owner[k]]),
                })

    return bodies.select("_near_key", "_near_text").mapInArrow(run, "_near_key binary, band long, rest double, total double")


def _buckets(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, _near_key, degree) of buckets with several texts; degree: companions over all buckets."""
    shared = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = members.join(shared, "band")
    degree = members.groupBy("_near_key").agg(F.sum(F.col("size") - 1).alias("degree"))
    return scratch.write("buckets", members.select("band", "_near_key").join(degree, "_near_key"))


def _rounds(open_: DataFrame, bodies: DataFrame, idf, least: float, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Verified links of each bucket's texts to its centres, and the texts that failed against a first centre."""
    found, first = [], None
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        centre = open_.groupBy("band").agg(F.max(F.struct("degree", "_near_key")).alias("centre"))
        tried = open_.join(centre.select("band", F.col("centre._near_key").alias("a")), "band").filter("a != _near_key")
        tried = scratch.write("tried", tried)
        good = scratch.write("verified", verified(tried.select("a", F.col("_near_key").alias("b")).distinct(), bodies, idf, least))
        found.append(good)
        failed = tried.join(good.select("a", F.col("b").alias("_near_key")), ["a", "_near_key"], "left_anti").select("band", "_near_key", "degree")
        failed = scratch.write("failed", failed)
        first = scratch.write("first", failed.select("_near_key").distinct()) if first is None else first
        several = failed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
        open_ = scratch.write("open", failed.join(several, "band", "left_semi"))
        scratch.drop("buckets", "tried", "failed")
    return found, first


def _counted(bodies: DataFrame, idf, least: float, scratch: Scratch) -> DataFrame:
    """The same as _prefixes, with shingles in the order of how many of these texts hold each."""
    sent = bodies.sparkSession.sparkContext.broadcast(idf)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in slices_of([len(x) for x in texts], PIECE):
                h, w, n = weighted_sets(texts[i:j], sent.value)
                owner = pa.array(np.repeat(np.arange(j - i), n))
                yield pa.RecordBatch.from_pydict({"_near_key": b.column(0)[i:j].take(owner), "band": pa.array(h.view(np.int64)), "weight": pa.array(w)})

    rows = scratch.write("shingles", bodies.select("_near_key", "_near_text").mapInArrow(run, "_near_key binary, band long, weight double"))
    held = scratch.write("held", rows.groupBy("band").agg(F.count("*").alias("held")))
    # Most held first, so that the running sum is the weight from a shingle on.
    own = Window.partitionBy("_near_key")
    upwards = own.orderBy(F.desc("held"), F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(held, "band").select("_near_key", "band", F.sum("weight").over(upwards).alias("rest"), F.sum("weight").over(own).alias("total"))
    return rows.filter(F.col("rest") >= least * (1 - 1e-9) * F.col("total"))


def _sharing(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts of different components that share a prefix shingle and enough weight from it on; a has failed."""
    x = rows.filter("failed").select("band", F.col("_near_key").alias("a"), F.col("label").alias("la"), F.col("rest").alias("ra"), F.col("total").alias("wa"))
    y = rows.select("band", F.col("_near_key").alias("b"), F.col("label").alias("lb"), F.col("rest").alias("rb"), F.col("total").alias("wb"), "failed")
    # Of the first shingle that a pair shares on, both must have what is shared: least / (1 + least) of the sum of their weights.
    enough = F.least("ra", "rb") >= (F.col("wa") + F.col("wb")) * (least / (1 + least) * (1 - 1e-9))
    return x.join(y, "band").filter("la != lb AND (a < b OR NOT failed)").filter(enough).select("a", "b")


def _missed(failed: DataFrame, found: DataFrame, bodies: DataFrame, idf, lengths: np.ndarray, least: float, scratch: Scratch) -> DataFrame:
    """Verified links of the texts in ``failed`` to texts of other components, all those there are."""
    texts = bodies.select("_near_key").join(components(found).withColumnRenamed("node", "_near_key"), "_near_key", "left")
    texts = texts.join(failed.withColumn("failed", F.lit(True)), "_near_key", "left")
    texts = scratch.write("components", texts.select("_near_key", F.coalesce("label", "_near_key").alias("label"), F.coalesce("failed", F.lit(False)).alias("failed")))
    rows = scratch.write("prefixes", _prefixes(bodies, idf, lengths, least).join(texts, "_near_key"))
    crowded = scratch.write("crowded", rows.filter("failed").groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("band"))
    pairs = _sharing(rows.join(crowded, "band", "left_anti"), least)
    if not crowded.isEmpty():
        pairs = scratch.write("uncrowded", pairs)
        some = scratch.write("crowd", rows.join(crowded, "band", "left_semi").select("_near_key").distinct())
        scratch.drop("prefixes")
        again = scratch.write("counted", _counted(bodies.join(some, "_near_key", "left_semi"), idf, least, scratch).join(texts, "_near_key"))
        scratch.drop("shingles", "held", "crowd")
        pairs = pairs.union(_sharing(again, least))
    return scratch.write("verified", verified(scratch.write("pairs", pairs.distinct()), bodies, idf, least))


def links(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """Verified pairs (a, b, similarity) of keys of different texts, each pair once; enough of them to connect every class."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(text_key(text).alias("_near_key"), text_of(text).alias("_near_text"))
    texts = scratch.write("distinct", keyed.groupBy("_near_key").agg(F.first("_near_text").alias("_near_text")))
    idf, lengths = common_shingles(texts, "_near_text")
    members = band_table(texts, idf, "_near_text").filter("_near_bands IS NOT NULL").select("_near_key", F.explode("_near_bands").alias("band"))
    open_ = _buckets(scratch.write("bands", members), scratch)
    bodies = scratch.write("bodies", texts.join(open_.select("_near_key"), "_near_key", "left_semi"))
    scratch.drop("distinct", "bands")
    found, failed = _rounds(open_, bodies, idf, least, scratch)
    if found and not failed.isEmpty():
        found.append(_missed(failed, functools.reduce(DataFrame.union, found), bodies, idf, lengths, least, scratch))
    scratch.drop_but("verified")
    if not found:
        return docs.sparkSession.createDataFrame([], "a binary, b binary, similarity double")
    every = functools.reduce(DataFrame.union, found)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").dropDuplicates(["a", "b"])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each distinct text: _near_key, class_id (least id in its class), class_rows, n_verified (links to other texts that were verified; a class may hold more)."""
    found = materialize(links(docs, text), "links")
    labels = components(found)
    own = docs.select(text_key(text).alias("_near_key"), F.col(doc_id).alias("_near_id")).groupBy("_near_key", "_near_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("_near_id").isNull(), "_near_id", "n"))
    own = own.groupBy("_near_key").agg(least["_near_id"].alias("_near_id"), least["n"].alias("_near_same"), F.sum("n").alias("_near_rows"))
    n = found.select(F.col("a").alias("_near_key")).union(found.select("b")).groupBy("_near_key").agg(F.count("*").alias("n_verified"))
    own = own.join(labels.withColumnRenamed("node", "_near_key"), "_near_key", "left").join(n, "_near_key", "left")
    own = materialize(own.withColumn("label", F.coalesce("label", "_near_key")), "texts")
    groups = own.groupBy("label").agg(F.min("_near_id").alias("class_id"), F.min(F.struct(F.col("_near_id").isNull(), "_near_id", "_near_key"))["_near_key"].alias("_near_first"), F.sum("_near_rows").alias("class_rows"))
    return own.join(groups, "label").select("_near_key", "_near_id", "_near_same", "_near_first", "class_id", "class_rows", F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the least id, with the columns of ``docs``."""
    winners = classes(docs, doc_id, text).filter(F.col("_near_key") == F.col("_near_first")).select("_near_key", "_near_id", "_near_same")
    winners = materialize(winners, "winners")
    rows = docs.withColumns({"_near_key": text_key(text), "_near_own": F.col(doc_id)})
    same = rows["_near_own"].eqNullSafe(winners["_near_id"])
    kept = rows.join(winners, (rows["_near_key"] == winners["_near_key"]) & same, "left_semi")
    if not winners.filter("_near_same > 1").isEmpty():  # rows of equal id and text
        kept = kept.dropDuplicates(["_near_key"])
    return kept.select(*docs.columns)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs).select("_near_key", "class_id", "class_rows", "n_verified")
    rows = docs.select("doc_id", text_key().alias("_near_key")).join(found, "_near_key")
    return rows.select("doc_id", "class_id", "class_rows", "n_verified", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
