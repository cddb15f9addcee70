"""Substring search of many queries: postings of character grams, candidates by intersection, verification.

A tier is a gram length ``k`` and a window ``w``: of every ``w`` neighbouring grams of a text
the one of the least hash is posted, about 2 in ``w + 1``. A query of ``k + w - 1`` characters
or more shares a whole window with any text that holds it, so each gram that the query posts
is one that the text posts. Queries use the longest tier that fits them; queries of ``WHOLE``
characters or fewer are grams themselves, found with their place. Only grams that some query asks for leave a text's
task; of those, each query takes its ``RAREST``, texts with all of them are candidates, and a
candidate's text is searched. Queries go in blocks of ``SENT`` chosen grams or so; a block and the
first ``HEAD`` characters of its queries are sent to every task, which searches a text where it
reads it, so a row that is found costs a search and two numbers. Beyond ``BLOCKS`` blocks grams
are shuffled. Neither texts nor whole queries pass the driver.

A few queries (``FEW``) are cheaper to look for in each text directly, and are; the result is
the same.

Cases: a query is trimmed and put in lower case, an empty one finds every row, a null one
none; null fields are left out of a text; repeated queries are one; rows with one id are
found row by row; texts of any length are posted whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import text as X
from inkwell.operators.dedup import written
from inkwell.operators.workers import ship

#: (k, w) of each tier, and the shortest query it serves.
WHOLE = 12
TIERS = (*((k, 1) for k in range(1, WHOLE + 1)), (8, 6), (12, 8))
RAREST, SHARE, SAMPLED, FEW, SENT, PIECE = 3, 16, 8192, 64, 200_000, 1 << 20
BLOCKS, HEAD, ROWS = 16, 64, 100_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.append(np.uint64(1), np.full(16, BASE)))


def tier_of(needle: Column) -> Column:
    """The tier of a query's length, -1 for an empty one."""
    out = F.lit(-1)
    for t, (k, w) in enumerate(TIERS):
        out = F.when(F.length(needle) >= k + w - 1, t).otherwise(out)
    return out


def _hashes(c: np.ndarray, k: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Hashes of all k neighbouring numbers, of those of two parts, of which the first has a power of two numbers."""
    if k == 1:
        return c
    if k not in known:
        n = 1 << (k - 1).bit_length() - 1
        known[k] = _hashes(c, n, known)[: max(len(c) - k + 1, 0)] * POWERS[k - n] + _hashes(c, k - n, known)[n:]
    return known[k]


def pieces_of(text: str) -> Iterator[tuple[int, np.ndarray, dict[int, np.ndarray]]]:
    """A text in pieces of characters, numbered, that overlap by the longest window: where each begins, and its hashes so far."""
    over = max(k + w - 2 for k, w in TIERS)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + over].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        c += np.uint64(1)
        yield at, c, {}


def posted_of(c: np.ndarray, known: dict[int, np.ndarray], tier: int) -> np.ndarray:
    """The hashes that a piece posts in a tier, some more than once; in a tier without windows, one a place."""
    k, w = TIERS[tier]
    if len(c) < k + w - 1:
        return np.zeros(0, np.uint64)
    h = _hashes(c, k, known)
    if w == 1:
        return h
    h = h ^ (h >> np.uint64(31))
    h *= MIX
    h ^= h >> np.uint64(29)
    least, n = h, 1
    while n < w:
        m = min(n, w - n)
        least, n = np.minimum(least[: len(least) - m], least[m:]), n + m
    changed = np.ones(len(least), bool)
    changed[1:] = least[1:] != least[:-1]
    return least[changed]


def grams(text: str, tier: int) -> np.ndarray:
    """The hashes that a text posts in a tier, each once."""
    found = [posted_of(c, known, tier) for _, c, known in pieces_of(text)]
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


class Chosen:
    """Chosen grams of bounded number and the needles that each is one of."""

    def __init__(self, tier: np.ndarray, gram: np.ndarray, needle: np.ndarray):
        self.names, needle, self.n = np.unique(needle, return_inverse=True, return_counts=True)
        self.tiers = []
        for t in np.unique(tier).tolist():
            some = np.flatnonzero(tier == t)
            some = some[np.argsort(gram[some].view(np.uint64), kind="stable")]
            key = gram[some].view(np.uint64)
            size = min(max(len(key).bit_length() + 6, 12), 22)  # a bit in 64 or so, and small enough for a cache
            bits = np.zeros(1 << size, bool)
            bits[key >> np.uint64(64 - size)] = True
            self.tiers.append((t, key, needle[some], np.uint64(64 - size), bits))

    def within(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The needles all of whose grams a text posts, as places in ``names``, and where the text may hold them: a place for a needle that is a gram, or 0."""
        posted, places = [[] for _ in self.tiers], [[] for _ in self.tiers]
        for begin, c, known in pieces_of(text):
            for n, (t, _, _, shift, bits) in enumerate(self.tiers):
                h = posted_of(c, known, t)
                at = bits.take((h >> shift).view(np.int64)).nonzero()[0]
                if len(at):
                    posted[n].append(h[at])
                    places[n].append(at + begin)
        none = np.zeros(0, np.int64)
        grams, whole, where = [none], [none], [none]
        for n, (t, key, needle, _, _) in enumerate(self.tiers):
            if not posted[n]:
                continue
            h = np.concatenate(posted[n])
            h = h if TIERS[t][1] == 1 else np.unique(h)
            low = key.searchsorted(h)
            times = key.searchsorted(h, "right") - low
            met = needle[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            if TIERS[t][1] == 1:
                whole.append(met)
                where.append(np.repeat(np.concatenate(places[n]), times))
            else:
                grams.append(met)
        whole, first = np.unique(np.concatenate(whole), return_index=True)
        found, times = np.unique(np.concatenate(grams), return_counts=True)
        found = found[times == self.n[found]]
        return np.append(whole, found), np.append(np.concatenate(where)[first], np.zeros(len(found), np.int64))


def posted(rows: DataFrame, text: str, tiers: list[int] | None, key: str) -> DataFrame:
    """(key, tier, grams): what each text posts in the tiers given, or in the one that its column ``tier`` names."""
    schema = T.StructType([rows.schema[key], T.StructField("tier", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    rows = rows.select(key, text, *([] if tiers is not None else ["tier"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                g = b.slice(i, 256)
                own = None if tiers is not None else g.column(2).to_pylist()
                at, kinds, found = [], [], []
                for k, t in enumerate(g.column(1)):
                    for tier in tiers if own is None else [own[k]]:
                        at.append(k)
                        kinds.append(tier)
                        found.append(grams(t.as_py() or "", tier))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays([g.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.int32()), lists], [key, "tier", "grams"])

    return rows.mapInArrow(run, schema)


def small(rows: DataFrame) -> DataFrame:
    """Rows to be sent to every task, if they are ``SENT`` at most."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def counted(texts: DataFrame, tiers: list[int]) -> DataFrame:
    """(tier, gram, n): in how many texts of some each gram is posted; a gram comes once from every few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = [t or "" for t in b.column(0)[i : i + 256].to_pylist()]
                for tier in tiers:
                    gram, n = np.unique(np.concatenate([grams(t, tier) for t in some]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), tier, np.int32)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["tier", "gram", "n"])

    return texts.select("text").mapInArrow(run, "tier int, gram long, n long")


def posts(texts: DataFrame, key: str, tiers: list[int]) -> DataFrame:
    return posted(texts, "text", tiers, key).select(key, "tier", F.explode("grams").alias("gram"))


def chosen(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(tier, gram, name): the ``RAREST`` grams of each needle, by how often one text in ``SHARE`` posts them, or ``SAMPLED`` texts or so.

    That decides how many candidates there are, not what is found: every text is searched for every needle.
    """
    wanted = written(posted(needles, "needle", None, "name").select("name", "tier", F.explode("grams").alias("gram")), "wanted")
    used = sorted(r["tier"] for r in wanted.select("tier").distinct().collect())
    share = max(SHARE, texts.count() // SAMPLED)
    used = [t for t in used if TIERS[t][1] > 1]  # in the others a needle is one gram
    some = counted(texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0), used)
    often = some.join(small(wanted.select("tier", "gram").distinct()), ["tier", "gram"], "left_semi").groupBy("tier", "gram").agg(F.sum("n").alias("often"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("often", "gram"))
    rare = wanted.join(often, ["tier", "gram"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    return written(rare.withColumn("rank", rank).filter(F.col("rank") <= RAREST).select("tier", "gram", "name"), "rare")


def found_at_hand(texts: DataFrame, needles: DataFrame, rare: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, id) where the chosen grams are few: every task has them, a text is read once and nothing is shuffled.

    A needle of ``HEAD`` characters or less is searched for in the task. Of a longer one its head is, and
    a text that has it goes on to be searched for the whole.
    """
    got = rare.toArrow()  # numbers, some ``SENT`` rows
    heads = needles.select("name", F.substring("needle", 1, HEAD).alias("head"), (F.length("needle") > HEAD).alias("longer")).toArrow()
    order = np.argsort(heads["name"].to_numpy())  # as Chosen has them
    sent = [got[c].to_numpy() for c in ("tier", "gram", "name")], heads["head"].combine_chunks().take(pa.array(order)), heads["longer"].to_numpy()[order]
    sent = texts.sparkSession.sparkContext.broadcast(sent)
    schema = T.StructType([texts.schema["id"], T.StructField("name", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, heads, longer = sent.value
        c, heads = Chosen(*numbers), heads.to_pylist()

        def rows(b: pa.RecordBatch, at: list[int], met: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            which, row = np.concatenate(met), np.repeat(at, [len(x) for x in met])
            for i in range(0, len(which), ROWS):
                k, r = which[i : i + ROWS], row[i : i + ROWS]
                text = b.column(1).take(pa.array(r, mask=~longer[k])) if longer[k].any() else pa.nulls(len(k), b.column(1).type)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(c.names[k]), text], ["id", "name", "text"])

        for b in batches:
            at, met, n = [], [], 0
            for r, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                found = [k for k, p in zip(*(x.tolist() for x in c.within(text)), strict=True) if text.startswith(heads[k], p) or heads[k] in text]
                if found:
                    at.append(r)
                    met.append(np.array(found, np.int64))
                    n += len(found)
                if n >= ROWS:
                    yield from rows(b, at, met)
                    at, met, n = [], [], 0
            if n:
                yield from rows(b, at, met)

    near = texts.select("id", "text").mapInArrow(run, schema)
    named = asked.join(needles.select("name", "needle"), "needle").select("name", "query", F.when(F.length("needle") > HEAD, F.col("needle")).alias("needle"))
    found = near.join(small(named), "name").filter(F.col("needle").isNull() | F.col("text").contains(F.col("needle")))
    return found.select("query", "id")


def found_by_shuffle(texts: DataFrame, needles: DataFrame, rare: DataFrame) -> DataFrame:
    """(id, needle) where they are many: texts' grams meet them by a join."""
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    used = sorted(r["tier"] for r in rare.select("tier").distinct().collect())
    n = rare.groupBy("name").agg(F.count("*").alias("n"))
    hits = posts(texts, "row", used).join(rare, ["tier", "gram"]).groupBy("row", "name").agg(F.count("*").alias("hits"))
    near = hits.join(n, "name").filter("hits = n").join(needles.select("name", "needle"), "name").select("row", "needle")
    return texts.join(near, "row").filter(F.col("text").contains(F.col("needle"))).select("id", "needle")


def searched(rows: DataFrame, queries: DataFrame, fields: list[Column], id_: str = "id", few: int = FEW) -> DataFrame:
    """(query, id): every query, trimmed and in lower case, as a part of a row's joined fields; an empty one finds all."""
    ship(rows.sparkSession)
    text = F.lower(F.concat_ws(" ", *fields))
    asked = queries.select("query").filter("query IS NOT NULL").distinct()
    asked = written(asked.withColumn("needle", F.lower(F.trim("query"))), "asked")
    some = asked.limit(few + 1).collect()
    if len(some) <= few:  # bounded by ``few``
        if not some:
            return rows.select(F.lit("").alias("query"), id_).limit(0)
        pairs = F.array(*[F.struct(F.lit(r["query"]).alias("query"), F.lit(r["needle"]).alias("needle")) for r in some])
        hits = X.bound(text, lambda t: F.transform(F.filter(pairs, lambda q: t.contains(q["needle"])), lambda q: q["query"]))
        return rows.select(F.explode(hits).alias("query"), id_)
    texts = rows.select(F.col(id_).alias("id"), text.alias("text"))
    needles = asked.select("needle").distinct().withColumn("tier", tier_of(F.col("needle"))).filter("tier >= 0")
    needles = written(needles.withColumn("name", F.monotonically_increasing_id()), "needles")
    rare = chosen(texts, needles)
    every = texts.select("id").join(small(asked.filter("needle = ''").select("query")))
    found = every.select("query", "id")
    n = rare.count()
    if n <= BLOCKS * SENT:
        blocks = -(-n // max(SENT, 1))
        of = lambda rows, k: rows.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k)
        for k in range(blocks):
            found = found.union(found_at_hand(texts, of(needles, k), of(rare, k), asked))
    else:
        found = found.union(found_by_shuffle(texts, needles, rare).join(asked, "needle").select("query", "id"))
    return found.select("query", F.col("id").alias(id_))
