"""Byte-pair encoding and decoding with forced boundaries.

A merge can only make tokens of the vocabulary. So where two neighbouring bytes never stand
side by side inside any token, every encoding has a boundary between them. Texts are cut
there, each fragment is encoded on its own, and the ids are concatenated. Fragments repeat
(most are words), so a bounded cache encodes a frequent one once per task.

The pattern that splits text ahead of the merges must see the same at a fragment's edge as
in the whole text. Cuts are therefore taken only in front of the first byte of a character
other than an apostrophe (it may begin a contraction) and only behind a character that is
surely no white space (white space looks ahead): printable ASCII, or a two-byte character
whose lead byte is C3 to DF.

Texts go through tasks in Arrow batches; nothing is shuffled, and a batch is worked on in
pieces of bounded size, so very long texts don't gather.

Cases: a null text is the empty text with no ids; the string of a special token inside a
text becomes that token's id, as in the library's default; repeated rows encode alike; an
empty table gives no rows; other columns pass through, but the added names replace equal ones.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import returning_memory, table

TOKENIZER = "byte_bpe_50k.json"
PIECE, CACHE, LONGEST = 1 << 20, 200_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (name of a public one, or a path)."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
        self.beside = np.zeros((256, 256), bool)
        for token, k in spec["model"]["vocab"].items():
            if token not in special:
                self.tokens[k] = b = bytes(letters[c] for c in token)
                for pair in zip(b, b[1:], strict=False):
                    self.beside[pair] = True
        for token, k in special.items():
            self.tokens[k] = token.encode()
        self.special = {t.encode(): np.array([k], "<u4").tobytes() for t, k in special.items()}
        self.cache: dict[bytes, bytes] = {}

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Offsets where every encoding has a boundary."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        left, right = b[:-1], b[1:]
        lead = np.concatenate([np.zeros(1, np.uint8), b[:-2]])
        solid = ((left >= 0x21) & (left <= 0x7E)) | ((left >= 0x80) & (left < 0xC0) & (lead >= 0xC3) & (lead <= 0xDF))
        forced = ~self.beside[left, right] & solid & ((right < 0x80) | (right >= 0xC0)) & (right != 0x27)
        return np.flatnonzero(forced) + 1

    def _fragments(self, parts: list[bytes]) -> list[bytes]:
        """The packed ids of each fragment."""
        known = self.cache
        new = list({p for p in parts if p not in known})
        if new:
            got = self.library.encode_batch([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)
            made = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(new, got, strict=True)}
            if len(known) > CACHE:
                known.clear()
                made |= {p: made[p] if p in made else self._one(p) for p in set(parts)}
            known.update(made)
        out = [known[p] for p in parts]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def _one(self, part: bytes) -> bytes:
        return np.array(self.library.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_plain(self, data: bytes) -> bytes:
        at = [0, *self.cuts(np.frombuffer(data, np.uint8)).tolist(), len(data)]
        out = []
        for i in range(0, len(at) - 1, 100_000):
            j = min(i + 100_000, len(at) - 1)
            out += self._fragments([data[a:b] for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True) if a < b])
        return b"".join(out)

    def encode(self, data: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = [data]
        for token in self.special:
            if token in data:
                parts = self._split(data)
                break
        return b"".join(self.special[p] if p in self.special and len(parts) > 1 else self._encode_plain(p) for p in parts)

    def _split(self, data: bytes) -> list[bytes]:
        return re.split(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")", data)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Many short texts as one: the ends of texts are cuts too."""
        if any(t in x for x in texts for t in self.special) or sum(map(len, texts)) > 2 * PIECE:
            return [self.encode(x) for x in texts]
        data = b"".join(texts)
        ends = np.cumsum([len(x) for x in texts])
        at = np.union1d(self.cuts(np.frombuffer(data, np.uint8)), np.append(ends, 0))
        where = at.tolist()
        ids = self._fragments([data[a:b] for a, b in zip(where, where[1:], strict=False)])
        last = np.searchsorted(at, ends).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *last], last, strict=False)]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(name: str) -> Codec:
    return Codec(name)


def _groups(b: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE bytes of text, one row at least."""
    i, total = 0, np.cumsum(size)
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE, "right")))
        yield b.slice(i, j - i)
        i = j


def _map(df: DataFrame, column: str, kind: type, added: list[tuple[str, T.DataType]], work, tokenizer: str) -> DataFrame:
    names = [n for n, _ in added]
    df = df.drop(*[n for n in names if n != column])
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(at)
            size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for g in _groups(b, size):
                made = work(codec(tokenizer), g.column(at).cast(kind).to_pylist())
                yield pa.RecordBatch.from_arrays([*g.columns, *made], [*g.schema.names, *names])
        codec(tokenizer).cache.clear()

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All rows with ``ids`` (packed little-endian 32-bit) and ``n_tokens``."""

    def work(c: Codec, texts: list[bytes | None]) -> list[pa.Array]:
        ids = c.encode_all([t or b"" for t in texts])
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]

    return _map(docs, text, pa.binary(), [("ids", T.BinaryType()), ("n_tokens", T.LongType())], work, tokenizer)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """All rows with ``decoded``, the text of the packed ids."""

    def work(c: Codec, packed: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([c.decode(p or b"") for p in packed], pa.string())]

    return _map(encoded, ids, pa.binary(), [("decoded", T.StringType())], work, tokenizer)


def round_trip(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task needs one Python worker and one codec."""

    def work(c: Codec, texts: list[bytes | None]) -> list[pa.Array]:
        ids = c.encode_all([t or b"" for t in texts])
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([c.decode(i) for i in ids], pa.string())]

    return _map(docs, text, pa.binary(), [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.StringType())], work, tokenizer)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
