"""Fingerprints against plain loops; near texts are more alike than neighbours."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from inkwell.llm import digests

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def plainly(data):
    """Length code and bucket codes by a loop over triplets."""
    found = [0] * digests.BUCKETS
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        found[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 24] += 1
    ranked = sorted(found)
    q = [ranked[64 * k - 1] for k in (1, 2, 3)]
    length = min(255, round(8 * float(np.log2(1 + len(data)))))
    return length, [sum(n > x for x in q) for n in found]


def printed(length, codes):
    bits = "".join(f"{c:02b}" for c in codes)
    return f"{length:02x}" + f"{int(bits, 2):0128x}"


def alike(a, b):
    apart = sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True))
    chance = sum(abs(x - y) for x in a[1] for y in b[1]) / 256
    return 1 - min(1, (apart / chance if chance else 0) + abs(a[0] - b[0]) / digests.FAR)


def expected(rows):
    hashed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), seed=42), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1] or "")))
    out = []
    for k, (i, t) in enumerate(order):
        t, follows = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + follows[:third]
        one, two, three = [plainly(x.encode()) for x in (t, new, follows)]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), printed(*one), printed(*two), alike(one, two), alike(one, three)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-9)


@pytest.mark.parametrize("parts", [1, 6])
def test_query_is_the_plain_one(spark, tmp_path, parts):
    rng = random.Random(7)
    rows = [(3 * k, words(rng, rng.randrange(1, 120))) for k in range(60)]
    rows += [(4, None), (5, ""), (7, "ab"), (7, "abc"), (7, "abc"), (None, "no id"), (None, None), (8, "é\U0001f600ü" * 9), (30, rows[10][1]), (11, words(rng, 30_000))]
    rows += [(50, f"tie {k}") for k in range(20)]
    spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 AS part", "'x' AS first", "2 AS fingerprint").write.parquet(f"{tmp_path}/documents.parquet")
    got = digests.op13_fingerprints(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same([tuple(r) for r in got.collect()], expected(rows))


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "alone in here")], SCHEMA)
    same([tuple(r) for r in digests.neighbours(one).collect()], expected([(1, "alone in here")]))
    assert digests.neighbours(one.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, n).encode() for n in (0, 1, 900, 3, 2500, 1)]
    want = digests.counts(texts)
    assert want.sum() == sum(max(0, len(t) - 2) for t in texts)
    monkeypatch.setattr(digests, "PIECE", 700)
    assert (digests.counts(texts) == want).all()


def test_fingerprints_of_any_table(spark):
    rng = random.Random(9)
    texts = [words(rng, n) for n in (40, 200, 1000)]
    near = [t[: 2 * len(t) // 3] + words(rng, len(t) // 18) for t in texts]
    rows = spark.createDataFrame([(*x, "theirs", 1) for x in zip(texts, near, texts[1:] + texts[:1], strict=True)], "text string, other string, far string, fingerprint string, likeness int")
    both = digests.fingerprinted(rows)
    for name in ("other", "far"):
        both = digests.fingerprinted(both, name, f"{name}_print")
    for name, low, high in (("fingerprint", 1.0, 1.0), ("other_print", 0.35, 0.9), ("far_print", 0.0, 0.3)):
        assert all(low <= r.likeness <= high for r in digests.compared(both, "fingerprint", name).collect())
    nulls = spark.createDataFrame([("00" * 65, None), (None, None), ("00" * 65, "00" * 65)], "a string, b string")
    assert [r.likeness for r in digests.compared(nulls, "a", "b").collect()] == [None, None, 1.0]
