"""The interaction feed: thresholds, hotness, creators, outcomes of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import lexicon as L
from inkwell.functions import text as X


def complete_thresholds(config: DataFrame, defaults=L.THRESHOLDS, clamp: bool = True) -> DataFrame:
    """All (platform, scope) pairs of the defaults; a missing or unparsable value is the default."""
    spark = config.sparkSession
    base = spark.createDataFrame([tuple(d) for d in defaults], "platform string, scope string, _likes int, _saves int")
    c = config.select("platform", "scope", F.expr("try_cast(likes AS int)").alias("likes"), F.expr("try_cast(saves AS int)").alias("saves"))
    out = base.join(c, ["platform", "scope"], "left")
    low = (lambda c: F.greatest(c, F.lit(0))) if clamp else (lambda c: c)
    return out.select("platform", "scope", low(F.coalesce("likes", "_likes")).alias("likes"), low(F.coalesce("saves", "_saves")).alias("saves"))


def with_hotness(videos: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add like_limit, save_limit, threshold, is_hot, reason. An unknown pair has the limits (0, 0).

    Thresholds have one row for each (platform, scope), a handful: the join is a broadcast.
    """
    t = thresholds.select("platform", "scope", F.col("likes").alias("like_limit"), F.col("saves").alias("save_limit"))
    out = videos.join(t, ["platform", "scope"], "left")
    out = out.withColumns({"like_limit": F.coalesce("like_limit", F.lit(0)), "save_limit": F.coalesce("save_limit", F.lit(0))})
    rule = F.format_string("%s %s: %d likes or %d saves", F.col("scope"), F.col("platform"), F.col("like_limit"), F.col("save_limit"))
    out = out.withColumn("threshold", rule).withColumn("is_hot", (F.col("likes") >= F.col("like_limit")) | (F.col("saves") >= F.col("save_limit")))
    start = F.when(F.col("is_hot"), F.lit("met")).otherwise(F.lit("not met"))
    return out.withColumn("reason", F.format_string("%s: %d likes, %d saves; rule %s", start, F.col("likes"), F.col("saves"), F.col("threshold")))


def topic_match(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: (F.trim(k) != "") & text.contains(F.trim(k)))


def missing_creators(candidates: DataFrame, creators: DataFrame, keywords=L.DISCOVERY) -> DataFrame:
    """Creators that candidates name and the table lacks, with default keywords, enabled."""
    names = candidates.select(F.col("creator").alias("name")).distinct().join(creators.select("name"), "name", "left_anti")
    return names.select("name", F.array(*map(F.lit, keywords)).alias("keywords"), F.lit(True).alias("enabled"))


def first_creators(candidates: DataFrame, creators: DataFrame, keywords=L.DISCOVERY, pos: str = "pos") -> DataFrame:
    """As above, with platform and scope of the creator's first candidate."""
    one = candidates.groupBy(F.trim("creator").alias("name")).agg(F.min_by(F.struct("platform", "scope"), pos).alias("_one"))
    names = one.join(creators.select("name"), "name", "left_anti")
    return names.select("name", "_one.platform", "_one.scope", F.array(*map(F.lit, keywords)).alias("keywords"), F.lit(True).alias("enabled"))


def video_key() -> Column:
    return F.nullif(X.video_url_key(F.col("original_url")), F.lit(""))


def outcomes(candidates: DataFrame, thresholds: DataFrame, stored: DataFrame, creators: DataFrame, keywords=L.DISCOVERY, pos: str = "pos", key: str | None = None) -> DataFrame:
    """Each candidate with one ``outcome``: not_hot, duplicate, disabled, off_topic, repeated or created.

    Gates run in this order: hotness, key stored already, creator enabled (a creator not
    known yet counts as enabled, with the default keywords), topic, first of its key.
    ``key`` names the column of ``stored`` that holds keys; without it they come from its URLs.
    """
    c = with_hotness(candidates, thresholds).withColumn("_key", video_key())
    known = stored.select((F.col(key) if key else video_key()).alias("_key")).distinct().withColumn("_stored", F.lit(True))
    c = c.join(known, "_key", "left")
    who = creators.select(F.col("name").alias("creator"), F.col("enabled").alias("_enabled"), F.col("keywords").alias("_keywords"))
    c = c.join(who, "creator", "left")
    on_topic = topic_match(F.concat_ws(" ", "title", "creator"), F.coalesce("_keywords", F.array(*map(F.lit, keywords))))
    gate = (
        F.when(~F.col("is_hot"), "not_hot").when(F.coalesce("_stored", F.lit(False)), "duplicate")
        .when(~F.coalesce("_enabled", F.lit(True)), "disabled").when(~on_topic, "off_topic").otherwise("created")
    )
    c = c.withColumn("_gate", gate)
    # Partial minima, not a window: a key with very many candidates is no hot task.
    first = c.filter("_gate = 'created' AND _key IS NOT NULL").groupBy("_key").agg(F.min(pos).alias("_first"))
    c = c.join(first, "_key", "left")
    late = (F.col("_gate") == "created") & F.col("_first").isNotNull() & (F.col(pos) > F.col("_first"))
    return c.withColumn("outcome", F.when(late, "repeated").otherwise(F.col("_gate"))).drop("_key", "_stored", "_enabled", "_keywords", "_gate", "_first")


def run_summary(found: DataFrame) -> DataFrame:
    """One row of counts over outcomes, with a status and a message."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    out = found.agg(F.count("*").alias("discovered"), (F.count("*") - n("not_hot")).alias("hot_matched"), n("duplicate", "repeated").alias("duplicate_skipped"), n("created").alias("created"))
    out = out.withColumn("scope_rejected", F.lit(0).cast("long")).withColumn("status", F.lit("success"))
    return out.withColumn("message", F.format_string("discovered %d, created %d, skipped %d", "discovered", "created", "duplicate_skipped"))


def counted(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition, and ``total``."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()], F.count("*").alias("total"))


def profiles(contents: DataFrame, key: str, text: str, phrases: dict = L.PROFILE_PHRASES, most: int = 6) -> DataFrame:
    """Which phrases of each list occur in any of a profile's texts, in the list's order, and how many texts it has.

    Flags are or-ed in partial aggregates, so texts never gather.
    """
    flags = [F.bool_or(F.col(text).contains(p)).alias(f"_{n}_{i}") for n, ps in phrases.items() for i, p in enumerate(ps)]
    out = contents.groupBy(key).agg(F.count("*").alias("content_count"), *flags)
    lists = [F.array_join(F.slice(F.filter(F.array(*[F.when(F.col(f"_{n}_{i}"), F.lit(p)) for i, p in enumerate(ps)]), lambda x: x.isNotNull()), 1, most), ",").alias(n) for n, ps in phrases.items()]
    return out.select(key, "content_count", *lists)


def profiled(names: DataFrame, contents: DataFrame, name: str, key: str, text: str, phrases: dict = L.PROFILE_PHRASES, most: int = 6) -> DataFrame:
    """All rows of ``names`` with the profile of their contents; empty lists and 0 where there are none."""
    found = profiles(contents, key, text, phrases, most).withColumnRenamed(key, name)
    out = names.join(found, name, "left")
    return out.withColumns({"content_count": F.coalesce("content_count", F.lit(0)).cast("long"), **{n: F.coalesce(n, F.lit("")) for n in phrases}})


def backfilled(stored: DataFrame, candidates: DataFrame, pos: str = "pos") -> DataFrame:
    """Stored rows whose empty play_url takes the first non-empty one of a candidate with their key."""
    key = X.video_url_key(F.col("original_url"))
    new = candidates.filter(F.coalesce(F.trim("play_url"), F.lit("")) != "").groupBy(key.alias("_key")).agg(F.min_by("play_url", pos).alias("_play"))
    out = stored.withColumn("_key", key).join(new, "_key", "left")
    return out.withColumn("play_url", F.coalesce(F.nullif(F.trim(F.coalesce("play_url", F.lit(""))), F.lit("")), "_play", F.lit(""))).drop("_key", "_play")
