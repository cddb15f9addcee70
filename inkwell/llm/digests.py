"""Document fingerprints: quartile digests of hashed byte triplets, compared by a bounded difference.

All byte triplets of a text are hashed into ``BUCKETS`` counters. The quartiles of the counters
turn each one into a code of two bits, 0 up to the first, 3 above the third; the codes and the
text's length on a logarithmic scale are the fingerprint, a hex string of fixed size. Two
fingerprints differ by the sum of their codes' differences, as a share of what independent
digests with the same codes would differ by, and by their lengths; the difference is bounded
by 1, and likeness is what remains.

A query on neighbours sorts the documents by range once; each task streams its range and
compares a row with the next one. The first and the last row of each range are written with
their text, and meet across ranges afterwards: two rows a partition.

Counting runs in numpy over pieces of bounded size, of one long text or of many short ones.

Cases: a null text is empty; texts of under three bytes have no triplet, all codes 0; equal
texts have equal fingerprints, also under one id; two texts without triplets are alike but
for their lengths; ids that tie come by their text's hash, null ids last; a single document is its own
neighbour; further columns pass through ``fingerprinted``, but one named as the added column
is replaced; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.llm.common import Scratch, returning_memory, table, text_of

BUCKETS = 256
#: Steps of the length scale an octave, and steps that make two lengths wholly different.
OCTAVE, FAR = 8, 24
PIECE = 1 << 20


def _hashed(b: np.ndarray) -> np.ndarray:
    """The bucket of each triplet."""
    x = b[:-2].astype(np.uint32)
    x <<= 8
    x |= b[1:-1]
    x <<= 8
    x |= b[2:]
    x *= np.uint32(2654435761)
    x >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    return x


def _piece_counts(texts: list[bytes]) -> np.ndarray:
    size = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < 3:
        return np.zeros((len(texts), BUCKETS), np.int64)
    key = _hashed(b).astype(np.int64)
    ends = np.cumsum(size)
    key += np.repeat(np.arange(len(texts)) * BUCKETS, size)[:-2]
    crossing = np.concatenate([ends - 2, ends - 1])
    inside = np.ones(len(key), bool)
    inside[crossing[(crossing >= 0) & (crossing < len(key))]] = False
    return np.bincount(key[inside], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)


def counts(texts: list[bytes]) -> np.ndarray:
    """Triplets of each text by bucket, counted in pieces of bounded size."""
    out, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append(_piece_counts(held))
        held, size = [], 0

    for t in texts:
        if len(t) > PIECE:
            flush()
            out.append(sum(_piece_counts([t[k : k + PIECE + 2]]) for k in range(0, len(t) - 2, PIECE)))
            continue
        held.append(t)
        size += len(t)
        if size > PIECE:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros((0, BUCKETS), np.int64)


def codes(found: np.ndarray) -> np.ndarray:
    """Each counter's quartile in its row, 0 to 3."""
    ranked = np.sort(found, axis=1)
    quartiles = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (found[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8)


def lengths(texts: list[bytes]) -> np.ndarray:
    return np.minimum(255, np.round(OCTAVE * np.log2(1 + np.array([len(t) for t in texts], float)))).astype(np.uint8)


def packed(length: np.ndarray, code: np.ndarray) -> list[str]:
    four = code.reshape(len(code), -1, 4)
    data = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    return [bytes(r).hex() for r in np.concatenate([length[:, None], data.astype(np.uint8)], axis=1)]


def unpacked(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    body = data[:, 1:]
    return data[:, 0], np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=2).reshape(len(prints), -1)


def likeness(length_a: np.ndarray, code_a: np.ndarray, length_b: np.ndarray, code_b: np.ndarray) -> np.ndarray:
    """1 less the bounded difference, row by row."""
    apart = np.abs(code_a.astype(np.int16) - code_b).sum(axis=1)
    levels = np.arange(4)
    shares_a, shares_b = [(c[:, :, None] == levels).mean(axis=1) for c in (code_a, code_b)]
    by_chance = BUCKETS * np.einsum("ri,ij,rj->r", shares_a, np.abs(levels[:, None] - levels), shares_b)
    share = np.divide(apart, by_chance, out=np.zeros(len(apart)), where=by_chance > 0)
    far = np.abs(length_a.astype(float) - length_b) / FAR
    return 1 - np.minimum(1, share + far)


def digest(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length codes, bucket codes) of texts."""
    return lengths(texts), codes(counts(texts))


# --- On tables ---------------------------------------------------------------------------------


def _groups(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about a piece of text, one row at least."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v.as_buffer() or b"") if v.is_valid else 0
        if size > PIECE or i - start >= 2000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows with the fingerprint of their text."""
    kept = docs if name == text else docs.drop(name)
    at = kept.columns.index(text)
    fields = [f for f in kept.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(at).cast(pa.binary())
            for i, j in _groups(values):
                prints = packed(*digest([t or b"" for t in values.slice(i, j - i).to_pylist()]))
                g = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[g.column(f.name) for f in fields], pa.array(prints, pa.string())], [*[f.name for f in fields], name])

    return kept.mapInArrow(returning_memory(run), schema)


def compared(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """All rows with the likeness, 0 to 1, of two fingerprint columns; null where one is null."""
    kept = pairs.drop(name)
    where = [kept.columns.index(c) for c in (a, b)]
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 1000):
                g = x.slice(i, 1000)
                both = [g.column(k).to_pylist() for k in where]
                full = [k for k in range(g.num_rows) if None not in (both[0][k], both[1][k])]
                out = [None] * g.num_rows
                if full:
                    found = likeness(*unpacked([both[0][k] for k in full]), *unpacked([both[1][k] for k in full]))
                    for k, v in zip(full, found.tolist(), strict=True):
                        out[k] = v
                yield pa.RecordBatch.from_arrays([*g.columns, pa.array(out, pa.float64())], [*g.schema.names, name])

    return kept.mapInArrow(returning_memory(run), schema)


RESULT = (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def beside(texts: list[str], following: list[str]) -> list[tuple]:
    """RESULT's values for each text and the one that follows it."""
    own, other = [t.encode("utf-8", "surrogatepass") for t in texts], [t.encode("utf-8", "surrogatepass") for t in following]
    new = [edited(t, f).encode("utf-8", "surrogatepass") for t, f in zip(texts, following, strict=True)]
    at = digest(own)
    apart = [k for k in range(len(other)) if k + 1 == len(other) or other[k] is not own[k + 1] and other[k] != own[k + 1]]
    far = digest([other[k] for k in apart])
    nexts = [np.concatenate([x[1:], x[:1]]) for x in at]  # the next row's own digest, but where another text follows
    for whole, some in zip(nexts, far, strict=True):
        whole[apart] = some
    made = digest(new)
    columns = (
        [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in new], packed(*at), packed(*made), likeness(*at, *made).tolist(), likeness(*at, *nexts).tolist())
    return list(zip(*columns, strict=True))


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both that and the next document, by descending id."""
    kind = docs.schema[doc_id].dataType
    result = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in RESULT))
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    given = pa.schema([("doc_id", to_arrow_type(kind)), *[(n, arrow[t]) for n, t in RESULT]])
    ends = pa.schema([*given, ("part", pa.int64()), ("first", pa.string()), ("last", pa.string())])
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumns({"_said": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = [F.col("doc_id").desc_nulls_last(), "_said", "_row"]  # the driver draws ranges from a sample of keys

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose next one is in this range, then one row with the range's ends: its last id, first and last text."""
        held: tuple | None = None
        first = None
        for b in batches:
            size = b.column(1).cast(pa.binary())
            for i, j in _groups(size):
                ids, texts = b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist()
                first = texts[0] if first is None else first
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                if len(texts) > 1:
                    made = beside(texts[:-1], texts[1:])
                    yield pa.RecordBatch.from_pylist([dict(zip(ends.names, (k, *m, None, None, None), strict=True)) for k, m in zip(ids, made, strict=False)], schema=ends)
        if held is not None:
            values = (held[0], *[None] * len(RESULT), TaskContext.get().partitionId(), first, held[1])
            yield pa.RecordBatch.from_pylist([dict(zip(ends.names, values, strict=True))], schema=ends)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                [made] = beside([r["last"]], [r["following"]])
                yield pa.RecordBatch.from_pylist([dict(zip(given.names, (r["doc_id"], *made), strict=True))], schema=given)

    schema = T.StructType([T.StructField("doc_id", kind), *result.fields])
    extra = T.StructType.fromDDL("part long, first string, last string")
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_said", "_row")
    made = Scratch(docs.sparkSession).write("along", sorted_.mapInArrow(returning_memory(along), T.StructType([*schema.fields, *extra.fields])))
    ranges = made.filter("part IS NOT NULL")  # one row a partition
    order = Window.orderBy("part")
    after = F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    closing = ranges.select("doc_id", "last", after.alias("following")).mapInArrow(across, schema)
    return made.filter("part IS NULL").select(*schema.names).unionByName(closing)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
