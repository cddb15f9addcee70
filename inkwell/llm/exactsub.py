"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere goes.

A suffix array of a whole corpus can't be shuffled, nor need it be. Of the hashes of all
CORE-byte strings inside a window of LENGTH bytes, the least one (the leftmost on ties) is
the window's anchor: equal windows have it at the same place. So only anchors, about one in
80 bytes, are shuffled, and only those whose core occurs twice are looked at again:

1. anchors of all texts, counted by core, with the least and greatest hash of the context:
   all bytes of windows that can hold the anchor;
2. cores met twice go back to their texts. Where all contexts of a core are one, it goes;
3. where they differ, the contexts' bytes follow: one met twice goes whole. Those that share
   only the core go to one task a core, are suffix-sorted to the right and to the left by
   hash comparisons (suffixes.py), and give the outermost windows that another context has,
   too, confirmed by the bytes. All windows hold the anchor, so they cover one run of bytes;
4. runs go back to their texts and are cut out.

A core with more than MOST contexts (a passage in very many surroundings) is not gathered
in a task: its windows become rows and are counted by Spark, which gives the same result.
Contexts are told apart by hashes of 64 bits within a core and 128 bits beyond; cores'
hashes only gather candidates.

Cases: null and empty texts have no bytes; texts under LENGTH bytes lose none; rows of equal
text, also with equal ids, are different places, so texts of LENGTH bytes and more that
repeat vanish whole; an empty table gives no rows. Helper columns start with ``_sub_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, table, text_of
from inkwell.llm.shingles import mixed, slices_of
from inkwell.llm.suffixes import BASE, repeated_span

LENGTH, CORE = 200, 41
WIDTH = LENGTH - CORE + 1  # cores in a window, and windows that can hold an anchor
LEFT = WIDTH - 1
PIECE, MOST, CHUNK = 1 << 19, 4000, 8000

KEY = ["k1", "k2"]


class Anchors:
    """Finds anchors; keeps its tables of powers."""

    def __init__(self) -> None:
        n = PIECE + 4 * LENGTH
        self.power = np.cumprod(np.full(n, BASE, np.uint64))
        self.back = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each start of a core in ``data`` its hash; for each start of a window, the place of its anchor. ``data`` is at most PIECE + 4 LENGTH bytes."""
        b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        p = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * self.power[: len(b)], out=p[1:])
        n = len(b) - CORE + 1
        h = mixed((p[CORE:] - p[:-CORE]) * self.back[:n])
        v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // WIDTH) * WIDTH, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = v
        blocks = padded.reshape(-1, WIDTH)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - WIDTH + 1
        least = np.minimum(behind[:m], ahead[WIDTH - 1 : WIDTH - 1 + m])
        return h, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors_of(find: Anchors, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the text, places of its anchors, hashes of their cores), for texts with a window."""
    for i, j in slices_of([len(t) for t in texts], PIECE):
        if j - i == 1 and len(texts[i]) > PIECE:
            t, got = texts[i], {}
            for s in range(0, len(t) - LENGTH + 1, PIECE):
                h, at = find(t[s : s + PIECE + LENGTH - 1])
                got |= {int(s + a): int(h[a]) for a in np.unique(at)}
            at = np.array(sorted(got), np.int64)
            yield i, at, np.array([got[a] for a in at.tolist()], np.uint64)
            continue
        data = b"".join(texts[i:j])
        if len(data) < LENGTH:
            continue
        h, at = find(data)
        end = 0
        for k in range(i, j):
            begin, end = end, end + len(texts[k])
            if end - begin >= LENGTH:
                own = at[begin : end - LENGTH + 1]
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                yield k, own - begin, h[own]


def _keys(texts: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(xxhash.xxh3_128_digest(t), "<i8") for t in texts], np.int64).reshape(-1, 2)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _context_hashes(text: bytes, places: list[int]) -> list[int]:
    """A 64-bit hash of each place's context and of how much of it stands ahead."""
    digest = xxhash.xxh3_64_intdigest
    return [digest(text[max(0, at - LEFT) : at + LENGTH], min(at, LEFT)) - (1 << 63) for at in places]


def _thin_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, key, at, around): key is the first half of the text's 128-bit key, which only names candidates; around is a hash of the context."""
    find = Anchors()
    for b in batches:
        all_texts = _bytes(b.column(0))
        for i, j in slices_of([len(t) for t in all_texts], 8 * PIECE):
            texts = all_texts[i:j]
            keys = _keys(texts)[:, 0] if texts else np.zeros(0, np.int64)
            got = list(_anchors_of(find, texts))
            if got:
                n = [len(a) for _, a, _ in got]
                yield pa.RecordBatch.from_pydict({
                    "core": pa.array(np.concatenate([c for _, _, c in got]).view(np.int64)),
                    "key": pa.array(np.repeat(keys[[k for k, _, _ in got]], n)),
                    "at": pa.array(np.concatenate([a for _, a, _ in got]).astype(np.int32)),
                    "around": pa.array([h for k, a, _ in got for h in _context_hashes(texts[k], a.tolist())], pa.int64()),
                })


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, n, places): each place as a run of bytes, and its context with a hash where contexts of its core differ."""
    names = ["k1", "k2", "at", "first", "last", "n", "core", "f1", "f2", "context"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        texts, places = _bytes(b.column(0)), b.column(2).to_pylist()
        for i, j in slices_of([8 * len(p) * LENGTH for p in places], 32 * PIECE):
            rows = []
            for k in range(i, j):
                t, key, n = texts[k], _keys([texts[k]])[0].tolist(), b.column(1)[k].as_py()
                for place in places[k]:
                    at = place["at"]
                    if at + CORE > len(t):
                        continue
                    first, last = max(0, at - LEFT), min(len(t), at + LENGTH)
                    more: tuple = (None, None, None, None)
                    if place["mixed"]:
                        context = t[first:last]
                        full = np.frombuffer(xxhash.xxh3_128_digest(context + (at - first).to_bytes(2, "little")), "<i8").tolist()
                        more = (np.frombuffer(xxhash.xxh3_64_digest(t[at : at + CORE]), "<i8")[0], *full, context)
                    rows.append((*key, at, first, last, n, *more))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts in order of core: (f1, f2, low, high), the outermost windows met again."""
    rest: list[tuple] = []

    def work(rows: list[tuple]) -> pa.RecordBatch:
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        rows, group = [rows[k] for k in order.tolist()], group[order]
        first = np.array([LEFT - r[3] for r in rows])
        last = first + np.array([len(r[4]) for r in rows])
        cells = np.frombuffer(b"".join(b"\0" * (LEFT - r[3]) + r[4] + b"\0" * (LEFT + LENGTH - (LEFT - r[3]) - len(r[4])) for r in rows), np.uint8).reshape(len(rows), LEFT + LENGTH)
        low, high = repeated_span(cells, group, first, last, LEFT, LENGTH)
        keep = np.flatnonzero(low <= high)
        pick = lambda i: pa.array([rows[k][i] for k in keep.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([pick(1), pick(2), pa.array(low[keep].astype(np.int32)), pa.array(high[keep].astype(np.int32))], ["f1", "f2", "low", "high"])

    for b in batches:
        rest += zip(*[b.column(i).to_pylist() for i in range(5)], strict=True)
        while len(rest) > CHUNK:  # all but the last core, which may go on
            k = CHUNK
            while k and rest[k - 1][0] == rest[k][0]:
                k -= 1
            if not k:
                break
            yield work(rest[:k])
            rest = rest[k:]
    if rest:
        yield work(rest)


def repeated_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each distinct text (k1, k2: its 128-bit key) the runs of bytes to remove, as (start, end), not yet merged."""
    bodies = docs.select(text_of(text).alias("t"))
    anchors = bodies.mapInArrow(_thin_anchors, "core long, key long, at int, around long")
    cores = anchors.groupBy("core").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("z")).filter("n > 1")
    cores = materialize(cores.select("core", (F.col("a") != F.col("z")).alias("mixed")), "cores")
    # No order and no group is asked of the large side, so a core in a third of all rows may be split.
    places = anchors.select("core", "key", "at").join(cores, "core").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "mixed"))).alias("places"))
    whole = bodies.groupBy(_spark_key("t").alias("address")).agg(F.first("t").alias("t"), F.count("*").alias("n"))
    whole = whole.mapInArrow(_with_key, "t string, n long, key long")
    found = whole.join(places, "key").select("t", "n", "places").mapInArrow(_contexts, "k1 long, k2 long, at int, first int, last int, n long, core long, f1 long, f2 long, context binary")
    found = materialize(found, "contexts")
    # Where all contexts of a core are one, and there are several, all of it goes.
    plain = found.filter("core IS NULL").select(*KEY, F.col("first").alias("start"), F.col("last").alias("end"))
    mixed = found.filter("core IS NOT NULL")
    full = materialize(mixed.groupBy("core", "f1", "f2").agg(F.sum("n").alias("n")), "full")
    large = materialize(full.groupBy("core").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > MOST).select("core"), "large")
    whole_runs = full.filter("n > 1").select("f1", "f2", F.lit(0).alias("low"), F.lit(LEFT).alias("high"))
    once = mixed.select("core", "f1", "f2", (F.col("at") - F.col("first")).alias("skip"), "context").groupBy("core", "f1", "f2").agg(F.first("skip").alias("skip"), F.first("context").alias("context"))
    some_large = not large.isEmpty()
    few = once.join(large, "core", "left_anti") if some_large else once
    part_runs = few.repartition("core").sortWithinPartitions("core").mapInArrow(_sorted_spans, "f1 long, f2 long, low int, high int")
    if some_large:
        part_runs = part_runs.union(_counted_spans(once.join(large, "core", "left_semi")))
    part_runs = part_runs.join(full.filter("n > 1").select("f1", "f2"), ["f1", "f2"], "left_anti")
    runs = materialize(whole_runs.union(part_runs), "runs")
    own = mixed.select(*KEY, "at", "f1", "f2", "first", "last").join(runs, ["f1", "f2"])
    return plain.union(own.select(*KEY, F.greatest("first", F.col("at") - F.col("high")), F.least("last", F.col("at") - F.col("low") + LENGTH)))


def _spark_key(column: str):
    return F.unhex(F.sha2(column, 256))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = _keys(_bytes(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(keys[:, 0])], ["t", "n", "key"])


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """The same as _sorted_spans, for cores with very many contexts: windows as rows."""
    w = contexts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(LEFT))))
    w = w.filter((F.col("o") <= F.col("skip")) & (F.col("skip") - F.col("o") + LENGTH <= F.length("context")))
    w = w.select("core", "f1", "f2", "o", F.unhex(F.md5(F.substring("context", F.col("skip") - F.col("o") + 1, F.lit(LENGTH)))).alias("window"))
    again = w.groupBy("core", "o", "window").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = materialize(again, "windows")
    return w.join(again, ["core", "o", "window"], "left_semi").groupBy("f1", "f2").agg(F.min("o").alias("low"), F.max("o").alias("high"))


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the runs, and the runs merged."""
    merged: list[list[int]] = []
    for a, z in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    edges = [0, *[x for m in merged for x in m], len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), [tuple(m) for m in merged]


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, spans): the remaining bytes and the removed runs of every row.

    Texts that lose nothing are finished by Spark; the others come together with their runs.
    """
    runs = materialize(repeated_runs(docs, text).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs")), "cuts")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t")).mapInArrow(_row_keys(docs, doc_id), f"doc_id {dict(docs.dtypes)[doc_id]}, t string, k1 long, k2 long")
    rows = rows.join(runs, KEY, "left").select("doc_id", "t", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts, all_runs = _bytes(b.column(1)), b.column(2).to_pylist()
            for i, j in slices_of([len(t) for t in all_texts], 8 * PIECE):
                made = [cut(t, [(x["start"], x["end"]) for x in r or ()]) for t, r in zip(all_texts[i:j], all_runs[i:j], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], pa.array([len(t) for t in all_texts[i:j]], pa.int64()), pa.array([m[0] for m in made], pa.binary()), pa.array([[{"start": a, "end": z} for a, z in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    ["doc_id", "n_bytes", "kept", "spans"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")


def _row_keys(docs: DataFrame, doc_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], [*b.schema.names, "k1", "k2"])

    return run


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return got.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
