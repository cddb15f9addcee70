"""Pieces of texts for retrieval: overlapping, cut at sentence bounds, with offsets.

A text is cut, without loss, into sentences: up to ``LONGEST`` characters that end none, with
the marks that follow; a longer run is cut there. Piece k holds the sentences that start within
``size`` characters from k times (``size`` - ``overlap``), so that a piece has fewer than
``size`` + ``LONGEST`` + 3 characters and each sentence is in one piece at least. Offsets are in
code points, ends exclusive; ``fresh`` is where a piece goes on beyond the one before it, so
that all of them rebuild the text.

Cases: a null or empty text has no pieces; a piece number that no sentence starts in is left
out of the count; rows of one id are pieces of each row; texts of any length are cut whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.operators.workers import ship

#: Marks that end a sentence, a fixed list of both scripts.
MARKS = "。！？.!?\n"
SIZE, OVERLAP, LONGEST = 800, 200, 400
PIECES = (("piece", pa.int32(), T.IntegerType()), ("start", pa.int64(), T.LongType()), ("fresh", pa.int64(), T.LongType()), ("end", pa.int64(), T.LongType()), ("text", pa.string(), T.StringType()))


def pattern(longest: int = LONGEST) -> str:
    return f"[^{MARKS}]{{1,{longest}}}[{MARKS}]{{0,3}}|[{MARKS}]{{1,{longest}}}"


def pieces_of(text: str, size: int, overlap: int, sentence: re.Pattern) -> Iterator[tuple[int, int, int]]:
    """(start, fresh, end) of each piece, in order."""
    step, seen = size - overlap, 0
    open_: dict[int, tuple[int, int]] = {}  # pieces that may still grow
    for m in sentence.finditer(text):
        last = m.start() // step
        for k in range(max(0, (m.start() - size) // step + 1), last + 1):
            start, _ = open_.get(k, (m.start(), 0))
            open_[k] = start, m.end()
        for k in sorted(k for k in open_ if k * step + size <= m.start()):
            start, end = open_.pop(k)
            yield start, seen, end
            seen = end
    for k in sorted(open_):
        start, end = open_[k]
        yield start, seen, end
        seen = end


def pieces(rows: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, longest: int = LONGEST) -> DataFrame:
    """(key, piece, start, fresh, end, text) of every row's text."""
    if not 0 <= overlap < size:
        raise ValueError("an overlap is less than a piece")
    ship(rows.sparkSession)
    sentence = re.compile(pattern(longest))
    names = [key, *[n for n, _, _ in PIECES]]
    arrow = pa.schema([(key, to_arrow_type(rows.schema[key].dataType)), *[(n, a) for n, a, _ in PIECES]])
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, _, t in PIECES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, chars = [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                for n, (start, fresh, end) in enumerate(pieces_of(t, size, overlap, sentence)):
                    held.append((k, n, start, fresh, end, t[start:end]))
                    chars += end - start
                    if chars > 1 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=arrow)
                        held, chars = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=arrow)

    return rows.select(key, text).mapInArrow(run, schema)


def rebuilt(made: DataFrame, key: str) -> DataFrame:
    """The texts again: what each piece adds, in order; a group is the pieces of one text."""
    adds = F.expr("substring(text, cast(fresh - start + 1 as int), cast(end - fresh as int))")
    parts = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece", adds.alias("adds")))).alias("parts"))
    return parts.select(key, F.array_join(F.transform("parts", lambda x: x["adds"]), "").alias("text"))
