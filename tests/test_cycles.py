"""Streams whose batches fail, replay of what was kept, and look-ups that read few buckets."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import committed, dedup
from inkwell.streaming import cycles
from inkwell.streaming.collect import collect_news, collect_videos, stored_news

NEWS = "pos int, url string, title string"
VIDEO = "pos int, title string, creator string, platform string, scope string, original_url string, play_url string, likes int, saves int"


class Feed:
    """Files that a news stream reads, one a batch."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, base

    def add(self, rows):
        self.spark.createDataFrame(rows, NEWS).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self, gate=lambda: F.lit(True)):
        stream = self.spark.readStream.schema(NEWS).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        q = collect_news(stream, f"{self.base}/news", f"{self.base}/log", f"{self.base}/cp", lambda: (F.col("url"), F.col("title")), gate)
        q.awaitTermination()
        assert q.exception() is None
        return sorted(r.pos for r in stored_news(self.spark, f"{self.base}/news", f"{NEWS}, url_key string, title_key string, batch bigint").collect())

    def log(self):
        return [(r.batch, r.attempt, r.status, r.discovered, r.created) for r in cycles.run_log(self.spark, f"{self.base}/log").orderBy("batch", "attempt").collect()]


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def bad_title():
    return F.when(F.col("title") == "bad", F.raise_error(F.lit("no such title"))).otherwise(F.lit(True)).cast("boolean")


def test_next_batch_is_stored_after_one_that_raises(spark, feed):
    feed.add([(1, "u1", "t1")])
    feed.add([(2, "u2", "bad"), (3, "u3", "t3")])
    feed.add([(4, "u4", "t4"), (5, "u1", "again")])
    assert feed.run(bad_title) == [1, 4]
    assert feed.log()[:3] == [(0, 1, "success", 1, 1), (1, 1, "failed", 2, 0), (1, 2, "failed", 2, 0)]
    assert "no such title" in cycles.run_log(spark, f"{feed.base}/log").filter("status = 'failed'").first().message
    assert cycles.failed_batches(spark, f"{feed.base}/news") == [1]
    feed.add([(6, "u3", "later copy")])
    assert feed.run() == [1, 2, 4, 6]  # kept rows come after the new batch, so 3 has become a copy
    assert feed.log()[-2:] == [(2, 1, "success", 2, 1), (3, 1, "success", 1, 1)] and (1, 3, "success", 2, 1) in feed.log()
    assert cycles.failed_batches(spark, f"{feed.base}/news") == []


def test_a_batch_that_never_works_is_left(spark, feed):
    feed.add([(0, "u0", "bad")])
    for k in range(1, 9):
        feed.add([(k, f"u{k}", f"t{k}")])
    assert feed.run(bad_title) == list(range(1, 9))
    assert [x[:3] for x in feed.log() if x[0] == 0] == [(0, k, "failed") for k in range(1, cycles.ATTEMPTS + 1)]
    kept = cycles.failed_rows(spark, f"{feed.base}/news", 0, spark.read.schema(NEWS).parquet(f"{feed.base}/in").schema)
    assert [r.title for r in kept.collect()] == ["bad"]


def test_batches_leave_no_tables_behind(spark, feed, monkeypatch):
    made = []
    path = dedup.shared_path
    monkeypatch.setattr(dedup, "shared_path", lambda df, name: made.append(p := path(df, name)) or p)
    feed.add([(1, "u1", "t1"), (2, "u1", "t2")])
    feed.add([(3, "u3", "bad")])
    feed.run(bad_title)
    assert made and not any(committed.names(spark, p) for p in made)


def test_video_cycle_fails_and_goes_on(spark, tmp_path):
    limits = spark.createDataFrame([("a", "b", 100, 100)], "platform string, scope string, likes int, saves int")
    none = spark.createDataFrame([], "name string, keywords array<string>, enabled boolean")
    calls = []

    def creators():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("creators can't be read")
        return none

    for k in (1, 2):
        row = (k, "高考", "m", "a", "b", f"https://d/video/{k}", "", 200, 0)
        spark.createDataFrame([row], VIDEO).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(VIDEO).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = collect_videos(stream, str(tmp_path / "t"), str(tmp_path / "log"), str(tmp_path / "cp"), limits, creators, ("高考",))
    q.awaitTermination()
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2]
    log = [(r.batch, r.attempt, r.status, r.created) for r in cycles.run_log(spark, str(tmp_path / "log")).orderBy("batch", "attempt").collect()]
    assert log == [(0, 1, "failed", 0), (0, 2, "success", 1), (1, 1, "success", 1)]


def test_rows_that_cannot_be_kept_end_the_query(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.add([(1, "u1", "t1")])
    stream = spark.readStream.schema(NEWS).parquet(f"{feed.base}/in").withColumn("title", F.raise_error(F.lit("unreadable")).cast("string"))
    q = collect_news(stream, f"{feed.base}/news", f"{feed.base}/log", f"{feed.base}/cp", lambda: (F.col("url"), F.col("title")), lambda: F.lit(True))
    with pytest.raises(Exception, match="unreadable"):
        q.awaitTermination()
    assert feed.run() == [1]  # nothing was marked as done


def test_lookup_reads_only_touched_buckets(spark, tmp_path):
    keys = cycles.StoredKeys(spark, str(tmp_path / "t"), buckets=32)
    keys.add(spark.range(5000).selectExpr("'url_key' AS kind", "concat('u', id) AS key"), 1)
    asked = spark.createDataFrame([("url_key", "u7"), ("url_key", "u9"), ("url_key", "none"), ("url_key", None)], "kind string, key string")
    near = keys.near(asked, 2)
    m = committed.manifest(spark, keys.path)
    some = set(committed.touched(m, asked))
    assert {int(re.search(r"_bucket=(\d+)", f).group(1)) for f in near.inputFiles()} == some and len(some) <= 4
    assert near.count() < 1000
    left = dedup.not_stored(asked, near, {"key": F.col("key")})
    assert sorted((r.key for r in left.collect()), key=str) == [None, "none"]
    assert keys.near(asked, 1).count() == 0  # what the batch wrote itself
    for k in range(2, 40):
        keys.add(spark.createDataFrame([("url_key", f"v{k}"), ("title_key", "")], "kind string, key string"), k)
    assert keys.near(asked, 99).filter("key in ('u7', 'u9')").count() == 2
    assert len(committed.names(spark, f"{keys.path}/manifests")) <= cycles.TIDY + 2


def test_a_table_from_before_the_index_is_indexed_once(spark, feed):
    old = spark.createDataFrame([(1, "u1", "t1", "u1", "t1")], f"{NEWS}, url_key string, title_key string")
    old.write.parquet(f"{feed.base}/news/batch=900")
    feed.add([(2, "u1", "new"), (3, "u3", "t1"), (4, "u4", "t4")])
    assert feed.run() == [1, 4]
