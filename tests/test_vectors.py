"""Vector search against plain loops: exact, by lists, on odd rows, hot vectors and clusters."""

from __future__ import annotations

import math
import random

import numpy as np

from inkwell.operators import dedup, vectors

SCHEMA = "id long, vector array<float>, list int, asker long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, 2) for i, v in rows], SCHEMA)


def loop(rows, asks, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in good:
        if not asks(i):
            continue
        some = sorted((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, round(-s, 6) + 0.0) for r, (s, j) in enumerate(some)}
    return out


def found(df):
    got = df.collect()
    assert len(got) == len({(r.id, r.rank) for r in got})
    return {(r.id, r.rank, r.neighbour, round(r.similarity, 6) + 0.0) for r in got}


def gauss(rng, n, dim):
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def test_exact_search_is_the_loop(spark):
    rng = random.Random(1)
    rows = list(enumerate(gauss(rng, 150, 6)))
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0, 0, 0, 0]), (204, [math.nan] * 6), (205, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(210, [1.0, 2.0]), (211, [2.0, 4.0]), (212, [-1.0, 0.5]), (220, [3.0])]  # other lengths
    rows += [(300 + k, [1.0, 0, 0, 0, 0, 0]) for k in range(70)] + [(400 + k, [2.0 + k, 0, 0, 0, 0, 0]) for k in range(9)]  # copies and ties
    df = frame(spark, rows)
    got = vectors.nearest(df, df.filter("id % 5 = 0"), dedup.shared_path(df, "nearest"), k=7)
    assert found(got) == loop(rows, lambda i: i % 5 == 0, 7)


def test_blocks_change_nothing(spark):
    rng = random.Random(2)
    rows = list(enumerate(gauss(rng, 300, 4)))
    df = frame(spark, rows)
    index = vectors.build(df, dedup.shared_path(df, "index"), lists=9, block=16)
    assert index.blocks.count() > 1 and index.blocks.agg({"blocks": "max"}).first()[0] > 1
    got = vectors.search(spark, index, df, k=5, probes=9)
    assert found(got) == loop(rows, lambda i: True, 5)


def test_recall_of_lists(spark):
    rng = random.Random(3)
    centres = gauss(rng, 12, 16)
    near = [[x + rng.gauss(0, 0.2) for x in centres[k % 12]] for k in range(3000)]
    for rows, most in ((list(enumerate(near)), 0.4), (list(enumerate(gauss(rng, 3000, 16))), 1)):
        df = frame(spark, rows)
        index = vectors.build(df, dedup.shared_path(df, "index"), lists=32, sample=1000)
        asked = df.filter("id % 20 = 0")
        got = vectors.search(spark, index, asked)
        assert got.count() == 1500
        truth = vectors.nearest(df, asked, dedup.shared_path(df, "nearest"))
        assert vectors.recall(got, truth) >= 0.9
        assert index.probes[16] <= most * 32


def test_recall_on_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0")
    got = vectors.search(spark, vectors.build(rows, dedup.shared_path(rows, "index"), "vec_id", "embedding"), asked, "vec_id", "embedding")
    truth = vectors.nearest(rows, asked, dedup.shared_path(rows, "nearest"), "vec_id", "embedding")
    assert vectors.recall(got, truth) >= 0.9


def test_no_rows(spark):
    df = frame(spark, [(1, None)])
    for lists in (1, 4):
        index = vectors.build(df, dedup.shared_path(df, "index"), lists=lists)
        assert vectors.search(spark, index, df).count() == 0
    one = frame(spark, [(1, [1.0, 0.0])])
    assert vectors.nearest(one, one, dedup.shared_path(one, "nearest")).count() == 0


def test_plan_has_no_cross_join(spark):
    df = frame(spark, list(enumerate(gauss(random.Random(4), 50, 3))))
    plan = vectors.nearest(df, df, dedup.shared_path(df, "nearest"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
