"""Rows against tables of words, names and facts: source names, tags, keywords, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import lexicon as L
from inkwell.functions import text as X
from inkwell.operators.distil import letters_of


def source_names(rows: DataFrame, key: str, names=L.SOURCE_NAMES, host: str = "host") -> DataFrame:
    """Add source_name: host suffixes meet a table of domains by equality; of several, the first listed wins."""
    table = rows.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(names)], "suffix string, name string, rank int")
    parts = F.split(host, r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = rows.select(key, F.explode(suffix).alias("suffix")).join(table, "suffix").groupBy(key).agg(F.min_by("name", "rank").alias("name"))
    return rows.join(found, key, "left").withColumn("source_name", F.coalesce("name", host)).drop("name")


def source_kind(url: Column, rules, other: str = "web") -> Column:
    """The kind of the first rule (kind, words) with a word in the URL."""
    return X.label(url, rules, other)


def tags_found(text: Column, rules) -> Column:
    """The tags whose pattern occurs, in the order of the rules."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in rules]), lambda t: t.isNotNull())


def rule_tags(text: Column, rules, other: str = "web", most: int = 5) -> Column:
    found = tags_found(text, rules)
    return F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(F.slice(found, 1, most))


def organized_tags(own: Column, text: Column, rules, dropped: tuple[str, ...], most: int = 5) -> Column:
    """A row's own tags but the dropped ones, then those that its text shows, once each."""
    return F.slice(F.array_union(F.array_except(own, F.array(*map(F.lit, dropped))), tags_found(text, rules)), 1, most)


def keyword_hits(text: Column, tags: Column, words=L.MATERIAL_KEYWORDS) -> Column:
    return F.slice(F.array_distinct(F.filter(F.concat(tags, X.hits(text, words)), lambda t: t != "")), 1, 10)


def infer_tags(kind: Column, tags: Column, source: Column, keywords: Column) -> Column:
    every = F.concat(F.array(kind), tags, F.array(F.coalesce(source, F.lit(""))), F.slice(keywords, 1, 4))
    return F.slice(F.array_distinct(F.filter(every, lambda t: t != "")), 1, 8)


def keyword_list(words: Column, default=L.DISCOVERY) -> Column:
    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    return F.when(F.size(kept) == 0, F.array(*map(F.lit, default))).otherwise(kept)


def evidence(points: DataFrame, facts: DataFrame, key: str, least: float = 0.12) -> DataFrame:
    """For each point the first fact of its document that is alike by letters; facts travel as one array a document.

    A point's letters are cut once, and no fact is looked at behind the first that is alike.
    """
    f = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_facts"))
    out = points.join(f, key, "left")
    pos = F.lit(None).cast(facts.schema["pos"].dataType)
    alike = lambda x, y: X.bound(F.size(F.array_intersect(x, y)), lambda both: both / (F.size(x) + F.size(y) - both) > least)
    near = lambda x, s: (s != "") & X.bound(letters_of(s), lambda y: alike(x, y))
    first = lambda x: F.aggregate("_facts", pos, lambda a, f: F.when(a.isNotNull(), a).when(near(x, f["sentence"]), f["pos"]))
    return out.withColumn("fact", F.when(F.col("sentence") != "", X.bound(letters_of(F.col("sentence")), first))).drop("_facts")
