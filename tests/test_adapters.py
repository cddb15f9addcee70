"""Adapters that fail alone, and a data source of a user's functions, batch and stream."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.operators import committed, dedup
from inkwell.sources import adapters


def test_others_rows_come_through(spark):
    def called():
        raise KeyError("no settings")

    made = spark.range(10).withColumn("title", F.when(F.col("id") == 7, F.raise_error(F.lit("torn"))).otherwise("t").cast("string"))
    some = spark.createDataFrame([("u1", "t1", 5), ("u2", None, 6)], "url string, title string, further int")
    with dedup.removed_after(spark):
        out, failures = adapters.gathered(spark, {"a": lambda: some, "called": called, "made": lambda: made, "none": lambda: some.limit(0)})
        assert [(r.adapter, r.url, r.title, r.summary, r.published_at) for r in out.orderBy("url").collect()] == [("a", "u1", "t1", None, None), ("a", "u2", None, None, None)]
        assert [f.adapter for f in failures] == ["called", "made"] and "no settings" in failures[0].message
        assert out.columns == ["adapter", *[n for n, _, _ in adapters.FIELDS]]
    assert adapters.gathered(spark, {})[0].count() == 0


def pages(options):
    return [n for n in os.listdir(options["path"]) if n.endswith(".json")]


def items(page, options):
    with open(os.path.join(options["path"], page)) as f:
        for x in json.load(f):
            yield x | ({"published_at": datetime(2024, 1, x["day"])} if "day" in x else {})


@pytest.fixture
def folder(spark, tmp_path):
    adapters.registered(spark, "test_pages", pages, items)

    def put(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))

    put("p1.json", [{"url": "u1", "title": "t1", "day": 3, "further": 1}, {"url": 5}, {}])
    put("p2.json", "not json")
    return str(tmp_path), put


def test_batch_source(spark, folder):
    path, _ = folder
    got = spark.read.format("test_pages").option("path", path).load()
    rows = sorted((r.page, r.pos if r.pos is not None else -1, r.url, r.title, r.published_at, r.error) for r in got.collect())
    assert rows[:1] + rows[2:3] == [("p1.json", 0, "u1", "t1", datetime(2024, 1, 3), None), ("p1.json", 2, None, None, None, None)]
    assert rows[1][5] == "item 1: wrong type of url" and rows[3][5].startswith("JSONDecodeError")
    assert len(rows) == 4
    out, failures = adapters.gathered(spark, {"pages": lambda: got.filter("error IS NULL")})
    assert out.count() == 2 and not failures


def test_stream_source(spark, folder, tmp_path):
    path, put = folder
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        stream = spark.readStream.format("test_pages").option("path", path).load()
        q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.page, r.url or "", (r.error or "")[:8]) for r in spark.read.parquet(target).collect())

    first = [("p1.json", "", ""), ("p1.json", "", "item 1: "), ("p1.json", "u1", ""), ("p2.json", "", "JSONDeco")]
    assert go() == first
    put("p3.json", [{"url": "u3"}])
    assert go() == [*first, ("p3.json", "u3", "")]
    assert go() == [*first, ("p3.json", "u3", "")]
    assert committed.names(spark, checkpoint)
