"""Provider payloads (JSON text) as rows: videos, transcripts, recognition results, search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.dedup import first_per_group


def json_text(column, *paths: str) -> Column:
    """The first path whose value is neither missing, empty, 0, false nor null."""
    got = [F.get_json_object(column, p) for p in paths]
    return F.coalesce(*[F.when(~F.coalesce(g, F.lit("")).isin("", "0", "null", "false", "[]", "{}"), g) for g in got])


def count_of(column, *paths: str) -> Column:
    return F.greatest(F.coalesce(json_text(column, *paths).try_cast("double").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def moment_of(column, *paths: str) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text."""
    v = json_text(column, *paths)
    number = v.try_cast("long")
    return F.when(number > 10_000_000_000, F.timestamp_millis(number)).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(F.try_to_timestamp(v))


def items_of(payloads: DataFrame, key: str, payload: str, lists: tuple[str, ...] = ("$.data.aweme_list", "$.aweme_list", "$.data.mix_list", "$.mix_list", "$.data.items", "$.items", "$.data", "$")) -> DataFrame:
    """One row an element of the first non-empty list among the places a provider may use."""
    parse = lambda p: F.from_json(F.get_json_object(payload, p), "array<string>")
    full = lambda p: F.when(F.get_json_object(payload, p).startswith("[") & (F.size(parse(p)) > 0), parse(p))
    return payloads.select(key, F.posexplode(F.coalesce(*map(full, lists))).alias("pos", "item"))


def videos_of(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Video rows; those without title, creator or URL are left out."""
    i = items_of(payloads, key, payload)
    own = json_text("item", "$.aweme_info")
    i = i.withColumn("item", F.coalesce(own, F.col("item")))
    vid = json_text("item", "$.aweme_id", "$.video_id", "$.id")
    url = F.coalesce(json_text("item", "$.share_url", "$.share_info.share_url", "$.url"), F.concat(F.lit("https://www.douyin.com/video/"), vid))
    out = i.select(
        key, "pos", json_text("item", "$.desc", "$.title", "$.caption").alias("title"), json_text("item", "$.author.nickname", "$.author.name", "$.creator").alias("creator"), url.alias("original_url"),
        count_of("item", "$.statistics.digg_count", "$.stats.diggCount", "$.likes").alias("likes"), count_of("item", "$.statistics.collect_count", "$.stats.collectCount", "$.saves").alias("saves"),
        moment_of("item", "$.create_time", "$.createTime", "$.published_at").alias("published_at"), media_url("item").alias("play_url"),
    )
    return out.dropna(subset=["title", "creator", "original_url"])


def media_url(column, paths: tuple[str, ...] = ("$.video.play_addr", "$.video.download_addr", "$.video.play_addr_h264")) -> Column:
    """The first http address among lists of addresses; empty if none."""
    lists = [F.coalesce(F.from_json(F.get_json_object(column, f"{p}.url_list"), "array<string>"), F.array().cast("array<string>")) for p in paths]
    return F.coalesce(F.try_element_at(F.filter(F.concat(*lists), lambda u: u.startswith("http")), F.lit(1)), F.lit(""))


def fanout(items: DataFrame, query: str = "query", topic: str = "topic", topic_pos: str = "topic_pos", item_pos: str = "item_pos", url: str = "url", published: str = "published_at", topics: int = 3, per_topic: int = 20) -> DataFrame:
    """The first topics of each query, the first items of each topic, each URL once, newest first."""
    t = first_per_group(items.select(query, topic, topic_pos).distinct(), [query], [F.col(topic_pos), F.col(topic)], topics)
    i = first_per_group(items.join(t.select(query, topic), [query, topic], "left_semi"), [query, topic], [F.col(item_pos)], per_topic)
    least = i.groupBy(url).agg(F.min(F.struct(query, topic_pos, item_pos)).alias("_first"))
    i = i.join(least, url).filter((F.col(query) == F.col("_first")[query]) & (F.col(topic_pos) == F.col("_first")[topic_pos]) & (F.col(item_pos) == F.col("_first")[item_pos]))
    return i.drop("_first").orderBy(F.col(published).desc_nulls_last(), F.col(url))


def recognized(column) -> tuple[Column, Column]:
    """(success, text) of a recognition result: a direct text, else its utterances or segments by line."""
    code = F.coalesce(F.get_json_object(column, "$.code"), F.get_json_object(column, "$.resp.code"), F.get_json_object(column, "$.status"))
    good = F.lower(F.coalesce(code, F.lit("0"))).isin("0", "1000", "20000000", "success", "succeeded", "done", "finished")
    direct = json_text(column, "$.text", "$.result.text", "$.data.text", "$.resp.text", "$.data.result.text")

    def parts(path: str) -> Column:
        rows = F.from_json(F.get_json_object(column, path), "array<struct<text:string>>")
        return F.nullif(F.array_join(F.filter(F.transform(rows, lambda r: F.trim(r["text"])), lambda t: t != ""), "\n"), F.lit(""))

    lists = ("$.result.utterances", "$.utterances", "$.data.utterances", "$.result.segments", "$.segments")
    return good, F.coalesce(direct, *[parts(p) for p in lists], F.lit(""))


def is_real_text(text: Column) -> Column:
    """Text that is more than hashtags."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"#[\p{L}\p{N}_]+|#|\s", "")) != ""


def picked_transcript(rows: DataFrame, speech: str = "speech_text", caption: str = "caption", video_text: str = "video_text", failure: str = "speech_error", hard: tuple[str, ...] = ("download", "expired", "decode")) -> DataFrame:
    """transcript and transcript_source: speech, else caption, else video text; a hard speech failure is carried along."""
    choice = F.coalesce(*[F.when(is_real_text(F.col(c)), F.struct(F.col(c).alias("text"), F.lit(s).alias("source"))) for c, s in ((speech, "speech"), (caption, "caption"), (video_text, "video text"))])
    bad = F.coalesce(F.exists(F.array(*map(F.lit, hard)), lambda m: F.col(failure).contains(m)), F.lit(False))
    out = rows.withColumn("_choice", choice).withColumn("transcript", F.coalesce(F.col("_choice.text"), F.lit("")))
    source = F.coalesce(F.col("_choice.source"), F.lit("none"))
    return out.withColumn("transcript_source", F.when(bad & (source != "speech"), F.concat(source, F.lit("; speech failed: "), F.col(failure))).otherwise(source)).drop("_choice")


def search_hits(payloads: DataFrame, key: str, payload: str, source: str = "web") -> DataFrame:
    rows = payloads.select(key, F.posexplode(F.from_json(F.get_json_object(payload, "$.articles"), "array<struct<title:string,url:string,source:string,summary:string,datetime:string>>")).alias("pos", "h"))
    out = rows.select(key, "pos", F.trim("h.title").alias("title"), F.trim("h.url").alias("url"), F.coalesce(F.nullif(F.trim("h.source"), F.lit("")), F.lit(source)).alias("source_name"), F.coalesce("h.summary", F.lit("")).alias("summary"))
    return out.filter("title != '' AND url != ''")
