"""Incremental collection with Structured Streaming: micro-batches against a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.dedup import first_wins, not_stored, written
from inkwell.operators.feed import backfilled, first_creators, outcomes, run_summary, video_key
from inkwell.streaming.cycles import StoredKeys, isolated, pairs


def stored_news(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def collect_news(stream: DataFrame, table_path: str, log_path: str, checkpoint: str, keys: Callable[[], tuple[Column, Column]], gate: Callable[[], Column], pos: str = "pos", seconds: int | None = None):
    """Start the query: gate, two-key dedup inside the batch, anti-join on both keys against the table, append, log.

    Each batch writes a folder of its own id (overwriting it on a retry), so a restart
    after a lost driver or executor appends nothing twice; one that fails is kept and tried
    again (see ``cycles``). Stored keys are looked up in their buckets, never in the whole
    table. Columns that must be kept are those of the stream; the two keys are stored with them.
    """
    fields = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, url_key string, title_key string, batch bigint"
    kinds = {"url_key": "url_key", "title_key": "title_key"}

    def work(batch: DataFrame, batch_id: int) -> tuple[DataFrame, Callable[[], None]]:
        spark = batch.sparkSession
        url, title = keys()
        known = StoredKeys(spark, table_path)
        known.filled(lambda: stored_news(spark, table_path, fields), kinds)
        rows = written(batch.withColumn("url_key", url).withColumn("title_key", title), "batch")
        kept = written(first_wins(rows.filter(gate()), pos, F.col("url_key"), F.col("title_key")), "kept")
        near = known.near(pairs(kept, kinds), batch_id)
        new = kept
        for kind in kinds:
            new = not_stored(new, near.filter(F.col("kind") == kind), {"key": F.col(kind)})
        new.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        new = spark.read.schema(fields).parquet(f"{table_path}/batch={batch_id}")
        return run_counts(rows.count(), new.count(), kept.count(), spark), lambda: known.add(pairs(new, kinds), batch_id)

    return started(stream, isolated(work, table_path, log_path, [table_path]), checkpoint, seconds)


def run_counts(discovered: int, created: int, kept: int, spark: SparkSession) -> DataFrame:
    row = [(discovered, created, kept - created, "success", f"discovered {discovered}, created {created}, skipped {kept - created}")]
    return spark.createDataFrame(row, "discovered long, created long, duplicate_skipped long, status string, message string").coalesce(1)


def started(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None):
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def stored_videos(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The videos that a stream stored, with their batch; empty play URLs as later batches filled them in."""
    late = stored_news(spark, f"{path}-play", "original_url string, play_url string, batch bigint")
    return backfilled(stored_news(spark, path, f"{schema}, batch bigint"), late, "batch")


CREATOR = "name string, platform string, scope string, keywords array<string>, enabled boolean"


def stored_creators(spark: SparkSession, path: str) -> DataFrame:
    """The creators that a stream met first, with their batch."""
    return stored_news(spark, path, f"{CREATOR}, batch bigint")


def collect_videos(stream: DataFrame, table_path: str, log_path: str, checkpoint: str, thresholds: DataFrame, creators: Callable[[], DataFrame], keywords: tuple[str, ...], seconds: int | None = None, pos: str = "pos"):
    """Start the query: each micro-batch of candidates gets its outcomes against the stored videos and creators.

    Created videos are appended. Creators that nobody knew are stored beside the table (in
    ``-creators``), with default keywords and enabled; a play URL of a candidate whose video
    is there already is stored (in ``-play``) for videos that have none. Counts are logged.
    As above, a batch writes folders of its own id, looks past what it wrote itself, is kept
    if it fails, and looks its keys up by bucket.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def work(batch: DataFrame, batch_id: int) -> tuple[DataFrame, Callable[[], None]]:
        spark = batch.sparkSession
        batch = written(batch, "batch")
        known = StoredKeys(spark, table_path)
        known.filled(lambda: stored_news(spark, table_path, f"{fields}, batch bigint").withColumn("_key", video_key()), {"video": "_key"})
        near = known.near(batch.select(video_key().alias("key")), batch_id)
        met = stored_creators(spark, f"{table_path}-creators").filter(F.col("batch") != batch_id).select("name", "keywords", "enabled")
        who = creators().select("name", "keywords", "enabled")
        who = who.unionByName(met.join(who.select("name"), "name", "left_anti").select(*who.columns))
        found = written(outcomes(batch, thresholds, near, who, keywords, pos, key="key"), "outcomes")
        new = first_creators(found.filter(F.col("outcome").isin("created", "off_topic")), who, keywords, pos)
        new.write.mode("overwrite").parquet(f"{table_path}-creators/batch={batch_id}")
        if "play_url" in batch.columns:
            late = found.filter(F.col("outcome").isin("duplicate", "repeated") & (F.coalesce(F.trim("play_url"), F.lit("")) != ""))
            late = late.groupBy("original_url").agg(F.min_by("play_url", pos).alias("play_url"))
            late.write.mode("overwrite").parquet(f"{table_path}-play/batch={batch_id}")
        created = found.filter("outcome = 'created'")
        created.select(*batch.columns).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        return run_summary(found), lambda: known.add(created.select(F.lit("video").alias("kind"), video_key().alias("key")), batch_id)

    return started(stream, isolated(work, table_path, log_path, [table_path, f"{table_path}-creators", f"{table_path}-play"]), checkpoint, seconds)


def arrived(stored: DataFrame, since: int | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Rows that came in batches after ``since``; without it, in the last batch.

    ``runs`` is the run log (``cycles.run_log``): a last batch that stored nothing brought nothing. Without it
    the last batch is the last that stored rows.
    """
    if since is None:
        last = (stored if runs is None else runs).agg(F.max("batch").cast("long").alias("batch"))
        return stored.join(F.broadcast(last), "batch", "left_semi")  # one row
    return stored.filter(F.col("batch") > since)
