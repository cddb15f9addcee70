"""Substring search through postings against a plain loop; both ways give the same rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import substrings

def loop(rows, queries):
    joined = [(i, " ".join(x for x in (a, b) if x is not None).lower()) for i, a, b in rows]
    return sorted(((q, i) for q in set(queries) - {None} for i, t in joined if q.strip(" ").lower() in t), key=str)


def found(spark, rows, queries, few):
    df = spark.createDataFrame(rows, "id long, title string, text string").selectExpr("*", "1 AS row", "'x' AS needle", "2 AS tier")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    got = substrings.searched(df.repartition(3), q, [F.col("title"), F.col("text")], few=few)
    assert got.columns == ["query", "id"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("few", "sent"), [(0, 200_000), (0, 0), (1000, 0)])
def test_is_the_loop(spark, monkeypatch, few, sent):
    monkeypatch.setattr(substrings, "SENT", sent)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(1, 6)))
    rows = [(k, word(), " ".join(word() for _ in range(rng.randrange(60)))) for k in range(120)]
    rows += [(200, None, None), (None, "no id abc", "x"), (7, "a second row of one id", "abc abc"), (300, "Common Line of Text", "UPPER"), (301, "", ""), (302, "a" * 50, "a" * 5000 + "b")]
    rows += [(400 + k, "common line of text", "copy") for k in range(30)]
    texts = [" ".join(x for x in r[1:] if x) for r in rows]
    queries = [t[at : at + n] for t in texts for n in (1, 2, 3, 4, 6, 7, 8, 14, 15, 16, 40) for at in [rng.randrange(max(1, len(t)))]]
    queries += ["", "  ", None, " common LINE ", "nowhere in any text", "zz", "É", "a" * 4000, "aaaaaaaaaaaaaaaab", "text copy", "xt cop"]
    assert found(spark, rows, queries, few) == loop(rows, queries)


def test_no_queries_and_no_rows(spark):
    for few in (-1, 5):
        assert found(spark, [(1, "a", "b")], [None], few) == []
        assert found(spark, [], ["a", ""], few) == []


def test_long_texts_are_posted_whole(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    want = [substrings.grams(text, t).tolist() for t in range(len(substrings.TIERS))]
    monkeypatch.setattr(substrings, "PIECE", 100)
    assert [substrings.grams(text, t).tolist() for t in range(len(substrings.TIERS))] == want
    for t, (k, w) in enumerate(substrings.TIERS):
        for _ in range(200):
            at, n = rng.randrange(2900), rng.randrange(k + w - 1, 60)
            some = set(substrings.grams(text[at : at + n], t).tolist())
            assert some and some <= set(want[t])


def test_queries_do_not_pass_the_driver(spark):
    rows = spark.createDataFrame([(1, "some text of a row")], "id long, text string")
    q = spark.range(500).selectExpr("concat('query ', id) AS query")
    plan = substrings.searched(rows, q, [F.col("text")])._jdf.queryExecution().optimizedPlan().toString()
    assert "query 7" not in plan and "LocalRelation" not in plan


@pytest.mark.parametrize("head", [64, 3])
def test_more_queries_than_a_block_are_not_shuffled(spark, monkeypatch, head):
    """Several blocks give the loop's rows; grams of texts meet queries in tasks, long queries are searched whole."""
    monkeypatch.setattr(substrings, "SENT", 100)
    monkeypatch.setattr(substrings, "HEAD", head)
    monkeypatch.setattr(substrings, "ROWS", 50)
    monkeypatch.setattr(substrings, "found_by_shuffle", None)
    rng = random.Random(8)
    rows = [(k, "t", " ".join(rng.choice(("ab", "abc", "é", "bcd\U0001f600")) for _ in range(60))) for k in range(90)]
    queries = [r[2][at : at + n] for r in rows for n in (3, 5, 9, 30, 90) for at in [rng.randrange(60)]] + ["", " AB", "ab "]
    assert found(spark, rows, queries, 0) == loop(rows, queries)


def test_hashes_of_grams_are_polynomials():
    c = [5, 1, 7, 3, 9, 2, 8, 6, 4, 11, 12, 10, 15, 13]
    for k in range(1, 13):
        want = []
        for i in range(len(c) - k + 1):
            h = 0
            for x in c[i : i + k]:
                h = (h * int(substrings.BASE) + x) % (1 << 64)
            want.append(h)
        assert substrings._hashes(np.array(c, np.uint64), k, {}).tolist() == want
