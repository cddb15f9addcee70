"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are lower-cased (A-Z only) runs of letters, digits and non-ASCII characters. A window
is ``size`` consecutive words of an item, or the whole item where it has fewer. Every window
of every training text is hashed and looked up in the set; a hit is verified word by word,
and then marks its words. Documents can be dropped, or their hit words cut out.

The set is broadcast only while it has at most ``most_broadcast`` windows; beyond that only
keys, places and hashes of windows are shuffled to the join, and the words of texts with a
candidate, few, are fetched to verify it. Items shorter than ``size`` add at most
``size`` - 1 further lengths of windows. Only DataFrame functions run.

Cases: null and empty texts have no words; an item without words has no window; an item
whose id is null marks words but has no id to list; repeated items and ids count once;
rows of equal text get equal results whatever their ids; empty tables give no hits. Helper
columns start with ``_dec_``, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import LOWER, UPPER, materialize, table, text_key

#: Characters of words, after and before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE, MOST_BROADCAST = 10, 200_000


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows with their hash and the sorted ids of the items that hold them."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(text).alias("words"))
    w = w.withColumn("n", F.size("words")).filter("n > 0").withColumn("len", F.least("n", F.lit(size)))
    w = w.withColumn("i", F.explode(F.expr("sequence(1, n - len + 1)")))
    w = w.select("item", "len", F.expr("slice(words, i, len)").alias("gram"))
    w = w.groupBy("gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return w.select(F.xxhash64("gram").alias("hash"), "len", F.array_join("gram", " ").alias("gram"), "items")


def find_hits(docs: DataFrame, windows: DataFrame, text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For each distinct text with a hit: its key, the hit windows (start, length) and the items.

    ``windows`` must be materialized: its size decides between broadcast and shuffle.
    """
    sizes = windows.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("len")).alias("lens")).first()
    lens = sizes["lens"] or [SIZE]
    few = sizes["n"] <= most_broadcast
    bodies = docs.select(text_key(text).alias("_dec_key"), words_of(text).alias("_dec_words"))
    d = bodies.withColumn("_dec_n", F.size("_dec_words")).filter(F.col("_dec_n") >= lens[0])
    d = d.withColumn("_dec_i", F.explode(F.sequence(F.lit(1), F.col("_dec_n") - (lens[0] - 1))))
    if len(lens) == 1:
        d = d.withColumn("_dec_len", F.lit(lens[0]))
    else:
        d = d.withColumn("_dec_len", F.explode(F.array(*map(F.lit, lens)))).filter("_dec_i + _dec_len - 1 <= _dec_n")
    gram = F.slice("_dec_words", F.col("_dec_i"), F.col("_dec_len"))
    d = d.withColumn("_dec_hash", F.xxhash64(gram))
    at = (d["_dec_hash"] == windows["hash"]) & (d["_dec_len"] == windows["len"])
    text_gram = F.array_join(gram, " ")
    # The equality is written so that it stays a check on rows whose hash matched, not a join key.
    same = F.startswith(text_gram, F.col("gram")) & F.startswith(F.col("gram"), text_gram)
    if few:
        hits = d.join(F.broadcast(windows), at & same)
    else:
        found = d.select("_dec_key", "_dec_i", "_dec_len", "_dec_hash").distinct().join(windows, at)
        found = materialize(found.select("_dec_key", "_dec_i", "_dec_len", "gram", "items"), "candidates")
        one = bodies.join(found.select("_dec_key").distinct(), "_dec_key", "left_semi").groupBy("_dec_key").agg(F.first("_dec_words").alias("_dec_words"))
        hits = found.join(one, "_dec_key").filter(same)
    hits = hits.groupBy("_dec_key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("_dec_i").alias("start"), F.col("_dec_len").alias("len")))).alias("_dec_spans"),
        F.collect_set("items").alias("_dec_items"),
    )
    return hits.withColumn("_dec_items", F.array_sort(F.array_distinct(F.flatten("_dec_items"))))


def hit_texts(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """A written table of the distinct texts with hits, and what hits them; small where few texts are contaminated."""
    windows = materialize(benchmark_windows(items, size), "windows")
    return materialize(find_hits(docs, windows, text), "hits")


def annotate(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with _dec_n_words, _dec_n_hit, _dec_items and _dec_spans.

    Hits are joined to the rows by content, so a text that is repeated in very many rows is
    a skewed key that adaptive execution may split. Words are counted below the join: where
    the caller drops the text, it isn't shuffled.
    """
    counted = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")
    out = docs.withColumns({"_dec_key": text_key(text), "_dec_n_words": counted})
    out = out.join(hit_texts(docs, items, size, text), "_dec_key", "left")
    covered = F.array_distinct(F.flatten(F.transform("_dec_spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    return out.withColumns({
        "_dec_n_hit": F.when(F.col("_dec_spans").isNull(), 0).otherwise(F.size(covered)).cast("long"),
        "_dec_items": F.coalesce("_dec_items", F.array().cast("array<string>")),
    }).drop("_dec_key")


def remove_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """Rows of ``docs`` without any hit, with their own columns."""
    hits = hit_texts(docs, items, size, text).select("_dec_key")
    return docs.withColumn("_dec_key", text_key(text)).join(hits, "_dec_key", "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """All rows, with the hit words (and what follows each up to the next word) cut out of the text."""
    marked = annotate(docs, items, size, text)
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?:{ANY_CASE_WORD})(?:[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(0))
    head = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    marked = marked.withColumn("_dec_parts", F.when(F.col("_dec_n_hit") > 0, parts))
    covered = F.flatten(F.transform("_dec_spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    marked = marked.withColumn("_dec_cut", F.array_distinct(covered))
    kept = F.array_join(F.filter("_dec_parts", lambda p, i: ~F.array_contains(F.col("_dec_cut"), i + 1)), "")
    marked = marked.withColumn("_dec_cleaned", F.when(F.col("_dec_n_hit") > 0, F.concat(head, kept)).otherwise(F.col(text)))
    return marked.select(*[F.col("_dec_cleaned").alias(c) if c == text else c for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = annotate(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.col("_dec_n_words").alias("n_words"),
        F.col("_dec_n_hit").alias("n_hit"),
        F.size("_dec_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_dec_items", ","), 256).alias("items_sha256"),
        (F.col("_dec_n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), {SIZE}) AS n, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bw),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_SQL_WORDS} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
pl AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p, (SELECT DISTINCT n FROM grams) WHERE i + n - 1 <= len(w)),
h AS (SELECT rid, i, pl.n AS n, item FROM pl JOIN grams USING (n, gram)),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, coalesce(array_to_string(list_sort(list(DISTINCT item)), ','), '') AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
