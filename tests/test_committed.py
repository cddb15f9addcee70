"""Committed tables: what each commit leaves, which buckets it touches, who sees what."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import committed

SCHEMA = "id long, version int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, version=None):
    return sorted((tuple(r) for r in committed.current(spark, path, version).collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    p = str(tmp_path / "table")
    m = committed.create(spark, p, frame(spark, []).schema, "id", 8)
    assert m.version == 0 and held(spark, p) == []
    assert committed.create(spark, p, frame(spark, []).schema, "id", 99) == m
    return p


def test_upsert_rewrites_only_touched_buckets(spark, path):
    first = committed.append(spark, path, frame(spark, [(k, 1, f"t{k}") for k in range(100)]))
    new = [(3, 2, "new"), (4, 0, "older"), (500, 1, "more"), (500, 2, "most"), (5, None, "null version"), (None, 1, "a"), (None, 1, "a")]
    second = committed.upsert(spark, path, frame(spark, new), "version")
    some = set(committed.touched(second, frame(spark, new)))
    assert 0 < len(some) < 8
    assert {b for b in range(8) if first.folders.get(b) != second.folders.get(b)} == some
    want = {k: (k, 1, f"t{k}") for k in range(100)} | {3: (3, 2, "new"), 500: (500, 2, "most")}
    assert held(spark, path) == sorted([*want.values(), (None, 1, "a"), (None, 1, "a")], key=str)
    assert held(spark, path, 1) == sorted(((k, 1, f"t{k}") for k in range(100)), key=str)


def test_reader_sees_one_version(spark, path):
    committed.append(spark, path, frame(spark, [(k, 1, "old") for k in range(50)]))
    before = committed.current(spark, path)
    committed.update(spark, path, F.col("id") < 40, {"text": F.lit("new")})
    committed.delete(spark, path, F.col("id") >= 45)
    assert before.filter("text = 'old'").count() == 50
    assert committed.current(spark, path).filter("text = 'new'").count() == 40 and committed.current(spark, path).count() == 45
    assert committed.vacuumed(spark, path) and committed.vacuumed(spark, path) == []
    assert committed.current(spark, path).count() == 45
    with pytest.raises(ValueError, match="no version 1"):
        committed.current(spark, path, 1)


def test_delete_and_update_touch_few(spark, path):
    m = committed.append(spark, path, frame(spark, [(k, 1, "x") for k in range(80)] + [(None, 1, None)]))
    keys = frame(spark, [(7, 0, ""), (7, 0, ""), (900, 0, ""), (None, 0, "")]).select("id")
    n = committed.delete(spark, path, F.lit(True), keys)
    assert [b for b in range(8) if m.folders.get(b) != n.folders.get(b)] == committed.touched(n, keys.filter("id = 7"))
    assert committed.current(spark, path).count() == 80  # a null key is never listed
    o = committed.delete(spark, path, F.col("text") == "none")
    assert o.folders == n.folders and o.version == n.version + 1
    p = committed.update(spark, path, F.col("id") == 8, {"text": F.lit("y"), "version": F.col("version") + 1})
    assert sum(o.folders.get(b) != p.folders.get(b) for b in range(8)) == 1
    assert (8, 2, "y") in held(spark, path) and len(held(spark, path)) == 80
    with pytest.raises(ValueError, match="key"):
        committed.update(spark, path, F.lit(True), {"id": F.lit(1)})


def test_second_writer_conflicts(spark, path):
    m = committed.append(spark, path, frame(spark, [(1, 1, "x")]))
    committed.append(spark, path, frame(spark, [(2, 1, "x")]))
    with pytest.raises(committed.Conflict):
        committed._replaced(spark, path, m, frame(spark, [(3, 1, "lost")]), [])
    assert [r[0] for r in held(spark, path)] == [1, 2]
    assert committed.names(spark, f"{path}/drafts") == []


def test_runs_are_merged(spark, path):
    for k in range(7):
        m = committed.append(spark, path, frame(spark, [(k % 2, k, "x")]), runs=3)
    assert max(map(len, m.folders.values())) <= 3
    assert len(held(spark, path)) == 7


@pytest.mark.parametrize("seed", range(2))
def test_random_commits(spark, path, seed):
    rng, want = random.Random(seed), {}
    for v in range(5):
        if rng.random() < 0.7:
            new = {rng.randrange(30): (v, rng.choice("ab")) for _ in range(rng.randrange(15))}
            committed.upsert(spark, path, frame(spark, [(k, *x) for k, x in new.items()]), "version")
            want |= new
        else:
            letter = rng.choice("ab")
            committed.delete(spark, path, F.col("text") == letter)
            want = {k: x for k, x in want.items() if x[1] != letter}
    assert held(spark, path) == sorted(((k, *x) for k, x in want.items()), key=str)
