"""Versions, pieces, reports, bounded streams and documents of workspaces, on small and odd cases."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunks, store, trends, versions
from inkwell.streaming import horizon

CHANGES = "doc string, at timestamp, seq int, text string, gone boolean"
DAY = datetime(2024, 1, 1)


def intervals(rows):
    """Each change with the next one's time, by loops; of one (doc, time, number) the greatest stays."""
    best = {}
    for doc, at, seq, *rest in rows:
        if doc is not None and at is not None:
            best[doc, at, seq] = max(best.get((doc, at, seq), rest), rest, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or False))
    out = set()
    for doc in {k[0] for k in best}:
        keys = sorted(k for k in best if k[0] == doc)
        out |= {(*k, *best[k], n[1] if n else None) for k, n in zip(keys, [*keys[1:], None], strict=True)}
    return out


def some_changes(rng, n):
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([DAY + timedelta(days=rng.randrange(200)), None] if rng.random() < 0.1 else [DAY + timedelta(days=rng.randrange(200))]), rng.randrange(3), rng.choice(["x", "y", None]), rng.choice([True, False, None])) for _ in range(n)]
    return rows


def got(df):
    return {(r.doc, r.at, r.seq, r.text, r.gone, r.valid_to) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_merging_gives_what_all_at_once_gives(spark, seed):
    rng = random.Random(seed)
    rows = some_changes(rng, 150)
    a, b, c = (spark.createDataFrame(rows[k::3], CHANGES) for k in range(3))
    held = versions.history(a, "doc", "at", "seq")
    assert got(held) == intervals(rows[0::3])
    held = versions.merged(held, b, "doc", "at", "seq")
    held = versions.merged(held, c.filter("doc = 'b'"), "doc", "at", "seq").select(*held.columns)
    assert got(held) == intervals([*rows[0::3], *rows[1::3], *[r for r in rows[2::3] if r[0] == "b"]])
    time = DAY + timedelta(days=100)
    want = {r[0]: r for r in got(held) if r[1] <= time and (r[5] is None or r[5] > time) and not r[4]}
    assert {r.doc: r.text for r in versions.as_of(held, "at", F.lit(time), "gone").collect()} == {k: r[3] for k, r in want.items()}


def test_condensed_versions(spark):
    rows = [("a", DAY + timedelta(days=k), 0, t, None) for k, t in enumerate([None, None, "x", "x", "y", "x"])]
    held = versions.history(spark.createDataFrame(rows, CHANGES), "doc", "at", "seq")
    short = versions.condensed(held, "doc", "at", "seq", ["text"], span="day")
    assert [(r.text, (r.at - DAY).days, r.valid_to and (r.valid_to - DAY).days) for r in short.orderBy("at").collect()] == [(None, 0, 2), ("x", 2, 4), ("y", 4, 5), ("x", 5, None)]
    assert versions.history(held.drop("valid_to").limit(0), "doc", "at", "seq").count() == 0


def test_pieces_rebuild_each_text(spark):
    rng = random.Random(1)
    texts = ["", None, "One. Two! Three?", "无标点" * 500, "句子。" * 900, ".!?" * 700, "\n\n\n", "é\U0001f600. " * 400, "x" * 5000]
    texts += ["".join(rng.choice(["word ", "a. ", "b?!\n", "…", "。"]) for _ in range(rng.randrange(900))) for _ in range(15)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "'x' AS piece", "1 AS start")
    for size, overlap, longest in ((800, 200, 400), (50, 0, 20), (40, 39, 7)):
        made = chunks.pieces(rows, "id", size=size, overlap=overlap, longest=longest)
        assert {r.id: r.text for r in chunks.rebuilt(made, "id").collect()} == {k: t for k, t in enumerate(texts) if t}
        by = {}
        for r in made.orderBy("id", "piece").collect():
            assert r.text == texts[r.id][r.start : r.end] and len(r.text) < size + longest + 3 and r.start <= r.fresh <= r.end
            by.setdefault(r.id, []).append(r)
        for k, ps in by.items():
            assert [p.piece for p in ps] == list(range(len(ps))) and ps[0].start == 0 and ps[-1].end == len(texts[k])
            assert all(p.end == q.fresh for p, q in zip(ps, ps[1:], strict=False))
    with pytest.raises(ValueError, match="overlap"):
        chunks.pieces(rows, "id", size=5, overlap=5)


def test_trends_fill_gaps(spark):
    rows = [("a", datetime(2024, 1, 4), 1.0), ("a", datetime(2024, 1, 10, 23), None), ("a", datetime(2024, 1, 25), 2.5), ("b", datetime(2024, 1, 12), 1.0), ("b", None, 9.0), (None, datetime(2024, 1, 4), 1.0)]
    out = trends.by_period(spark.createDataFrame(rows, "kind string, at timestamp, v double"), "kind", "at", "v")
    first = date(2024, 1, 4)
    want = {("a", 0): (2, 1.0, None), ("a", 1): (0, 0.0, -2), ("a", 2): (0, 0.0, 0), ("a", 3): (1, 2.5, 1), ("b", 0): (0, 0.0, None), ("b", 1): (1, 1.0, 1), ("b", 2): (0, 0.0, -1), ("b", 3): (0, 0.0, 0)}
    want |= {(None, 0): (1, 1.0, None), (None, 1): (0, 0.0, -1), (None, 2): (0, 0.0, 0), (None, 3): (0, 0.0, 0)}
    assert {(r.kind, (r.period - first).days // 7): (r.n, r.total, r.change) for r in out.collect()} == want
    assert trends.by_period(spark.createDataFrame([], "kind string, at timestamp, v double"), "kind", "at", "v").count() == 0


def test_stream_forgets_after_the_horizon(spark, tmp_path):
    """Copies inside the horizon go, a row behind it goes, and a key that was forgotten comes through again."""
    schema = "k string, at timestamp, n int"
    path = lambda n: str(tmp_path / n)
    hour = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    steps = [
        ([("a", hour(0), 1), ("", hour(0), 2), (None, hour(0), 3)], [1, 2, 3]),
        ([("a", hour(1), 4), ("b", hour(1), 5), (None, hour(0), 6)], [5, 6]),
        ([("c", hour(30), 7)], [7]),
        ([("d", hour(2), 8), ("", hour(2), 9)], [9]),  # d is behind the horizon; rows without a key are never late
        ([("c", hour(29), 10), ("a", hour(31), 11)], [11]),  # a was forgotten, c was not
    ]
    want = []
    for rows, more in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path("in"))
        once = horizon.first_within(spark.readStream.schema(schema).parquet(path("in")), F.col("k"), "at", "10 hours")
        once.writeStream.format("parquet").option("path", path("out")).option("checkpointLocation", path("cp")).trigger(availableNow=True).start().awaitTermination()
        want += more
        assert sorted(r.n for r in spark.read.parquet(path("out")).collect()) == sorted(want)


def test_documents_of_workspaces(spark):
    s = spark.createDataFrame([("w1", 2, 'quote " and \n'), ("w1", 1, None), (None, 3, "no workspace"), ("w2", 1, "]")], "ws string, id int, text string")
    made = store.export_documents({"sources": s, "tasks": s.limit(0)}, "ws", "2024-02-01")
    assert {r.ws for r in made.collect()} == {"w1", "w2", None}
    assert made.filter("ws = 'w2'").first().document == '{"version":1,"exportedAt":"2024-02-01","sources":[{"id":1,"text":"]"}],"tasks":[]}'
    bad = spark.createDataFrame([("x", "no json"), ("y", '{"sources":[]}'), ("z", '{"sources":{},"tasks":[]}'), ("n", None)], "ws string, document string")
    back, broken = store.import_documents(made.union(bad), "ws", {"sources": "id: INT, text: STRING", "tasks": "id: INT, text: STRING"})
    assert sorted(map(tuple, back["sources"].collect()), key=str) == sorted(map(tuple, s.collect()), key=str)
    assert back["tasks"].count() == 0 and sorted(r.ws for r in broken.collect()) == ["n", "x", "y", "z"]
