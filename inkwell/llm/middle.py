"""Fill-in-middle transformation: blocks of a text change places inside one bytearray.

A text is cut into lines; two hashes of its id choose the lines where its prefix and its
middle end. Sentinels are inserted into a bytearray of the text, ``<P>`` prefix ``<M>`` middle
``<S>`` suffix, and neighbouring blocks are exchanged in place by a rotation of three
reversals: the last two for the order prefix, suffix, middle (psm), the last one and the first
two for suffix, prefix, middle (spm). The inverse rotation, found from the sentinels and the
form alone, restores the text. A text that holds a sentinel stays plain, so those of a
transformed one are the only ones; none can arise where text and sentinel meet, as ``<`` and
``>`` stand only at a sentinel's ends.

Rows are worked on one at a time in Arrow batches, without a shuffle; memory is bounded by a
few copies of the longest text.

Cases: a null text is empty; an empty text stays plain; a null id is hashed as an empty one;
repeated rows and texts under one id are cut by the same hashes; a middle, prefix or suffix
may be empty; texts of any length are cut whole; further columns pass through, but those with
the added names, if there, are replaced; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from inkwell.llm.common import returning_memory, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = re.compile(b"<[PSM]>")
SEED, RATE, SPM = 7, 100, 50


def cuts(text: bytes) -> list[int]:
    """Byte offsets where units end, with 0 before them: lines with their newline, and what follows the last one."""
    out = [0, *[m.end() for m in re.finditer(b"\n", text)]]
    return out if out[-1] == len(text) else [*out, len(text)]


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the id's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def reverse(b: bytearray, i: int, j: int) -> None:
    b[i:j] = b[i:j][::-1]


def rotate(b: bytearray, i: int, j: int, k: int) -> None:
    """Exchange the neighbouring blocks [i, j) and [j, k): each is reversed, then both together."""
    reverse(b, i, j)
    reverse(b, j, k)
    reverse(b, i, k)


def transformed(text: bytes, doc_id, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytearray]:
    """(units, form, end of the prefix, end of the middle, output); offsets are in bytes, None in a plain text."""
    ends = cuts(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    b = bytearray(text)
    if not text or h3 % 100 >= rate or SENTINEL.search(text):
        return n, "plain", None, None, b
    first, second = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    b[second:second] = SUFFIX
    b[first:first] = MIDDLE
    b[0:0] = PREFIX
    at_middle, at_suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if h4 % 100 < spm:
        rotate(b, 0, at_suffix, len(b))
        return n, "spm", first, second, b
    rotate(b, at_middle, at_suffix, len(b))
    return n, "psm", first, second, b


def restored(output: bytes, form: str) -> bytearray:
    """The text again, from the output and its form alone."""
    b = bytearray(output)
    if form == "plain":
        return b
    if form == "spm":
        at = b.index(PREFIX)
        rotate(b, 0, at, len(b))
    else:
        at = b.index(SUFFIX)
        rotate(b, at, b.index(MIDDLE, at), len(b))
    at_middle = b.index(MIDDLE)
    at_suffix = b.index(SUFFIX, at_middle)
    for at in (at_suffix, at_middle, 0):
        del b[at : at + 3]
    return b


def _chars(b: bytes) -> int:
    return len(b.decode("utf-8", "replace"))


MADE = (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"))
TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _mapped(df: DataFrame, added: tuple[tuple[str, str], ...], inputs: list[str], one, without: tuple[str, ...] = ()) -> DataFrame:
    """All rows with new columns that ``one`` makes of a row's inputs, and without some; a text is read as bytes."""
    kept = df.drop(*[n for n, _ in added if n not in inputs])
    where = [kept.columns.index(c) for c in inputs]
    outputs = [f for f in kept.schema.fields if f.name not in {*dict(added), *without}]
    schema = T.StructType([*outputs, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in added)).fields])
    names = [f.name for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                g = b.slice(i, 256)
                read = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in (g.column(k) for k in where)]
                made = [one(*[v.as_py() for v in row]) for row in zip(*read, strict=True)]
                columns = [pa.array([m[k] for m in made], TYPES[t]) for k, (_, t) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*[g.column(n) for n in names], *columns], [*names, *[n for n, _ in added]])

    return kept.mapInArrow(returning_memory(run), schema)


def _id(doc_id):
    return doc_id.decode() if isinstance(doc_id, bytes) else doc_id


def _made(text: bytes | None, doc_id, seed: int, rate: int, spm: int) -> tuple:
    text = text or b""
    n, form, first, second, output = transformed(text, _id(doc_id), seed, rate, spm)
    chars = (None, None) if first is None else (_chars(text[:first]), _chars(text[first:second]))
    return n, form, *chars, output


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """All rows with n, form, prefix_chars, middle_chars and ``output``; ``rate`` and ``spm`` are in percent."""

    def one(value: bytes | None, key) -> tuple:
        *head, output = _made(value, key, seed, rate, spm)
        return *head, output.decode("utf-8", "replace")

    return _mapped(docs, MADE, [text, doc_id], one)


def restore(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """All rows with ``restored``, from the output and the form."""
    return _mapped(made, (("restored", "string"),), [output, form], lambda o, f: (None if o is None else restored(o, f.decode()).decode("utf-8", "replace"),))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, and digests of its output and of the text restored from it."""

    def one(text: bytes | None, doc_id) -> tuple:
        *head, output = _made(text, doc_id, SEED, RATE, SPM)
        return *head, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, head[1])).hexdigest()

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    added = (*MADE[:-1], ("output_sha256", "string"), ("restored_sha256", "string"))
    return _mapped(docs, added, ["text", "doc_id"], one, without=("text",))


#: Lines, hashes and the order of blocks, without the rotations.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines FROM d),
n AS (SELECT *, len(lines) AS n, t = '' OR regexp_matches(t, '<[PSM]>') AS plain,
  CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM l),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
