"""Sentences, their scores, diverse picks, transcripts and manuscripts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import lexicon as L
from inkwell.functions import text as X
from inkwell.operators.workers import ship

SLICE = 1024  # sentences whose pairs are counted at once, at least


def without_chapters(text: Column, labels=L.CHAPTERS) -> Column:
    """Without numbered chapter labels, labels that stand alone and a number in front."""
    any_, edge = "|".join(labels), r"[\s　，。、；：!?！？]"
    for pattern, new in ((rf"[\s　]*[0-9]{{1,2}}[\s　]*(?:{any_})", " "), (rf"(?:^|{edge})(?:{any_})(?={edge}|$)", ""), (r"^\s*[0-9]{1,2}\s+", ""), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def without_noise(text: Column, noise=L.NOISE_PHRASES, chapters=L.CHAPTERS) -> Column:
    """Without stock phrases, chapter labels, and doubled blanks and lines."""
    text = functools.reduce(lambda c, p: F.regexp_replace(c, p, ""), noise, text)
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t　]+", " "), "\n{2,}", "\n"))
    return without_chapters(text, chapters) if chapters else text


def without_promotion(rows: DataFrame, promotion=L.PROMOTION) -> DataFrame:
    """Sentences that don't advertise."""
    return rows.filter(~F.col("sentence").rlike("|".join(promotion)))


def too_short(core: Column, whole: Column, least_core: int = 50, least: int = 120) -> Column:
    """Why a text is not worth distilling; empty if it is."""
    return F.when(F.length(core) < least_core, "core too short").when(F.length(whole) < least, "too short").otherwise("")


def sentences(text: Column, least: int = 8) -> Column:
    """Sentences with their end mark, without list numbers; short ones go."""
    marked = F.regexp_replace(text, r"([。！？!?；;])", "$1\u0001")
    parts = F.transform(F.split(marked, "[\u0001\n]", -1), lambda s: F.regexp_replace(F.trim(s), r"^\s*([0-9]{1,2}[、.．)）]|[一二三四五六七八九十]{1,3}[、.]|[①-⑩])\s*", ""))
    parts = F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \-—·•]+|[ \-—·•]+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= least)


def sentence_table(docs: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    return exploded(docs, key, sentences(F.col(text), least))


def exploded(docs: DataFrame, key: str, cut: Column) -> DataFrame:
    """(key, pos, sentence). Outer, as else Spark cuts each text twice: a first time to leave out rows without sentences."""
    return docs.select(key, F.posexplode_outer(cut).alias("pos", "sentence")).filter("pos IS NOT NULL")


def whole_keys(batches: Iterator[pa.RecordBatch], least: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows that come in order of the first column, cut between its values into batches of ``least`` rows or more; a null equals none."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for b in batches:
        if not b.num_rows:
            continue
        k, begin = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), 0
        null = b.column(0).is_null().to_numpy(zero_copy_only=False)
        starts = (np.flatnonzero((k[1:] != k[:-1]) | null[1:]) + 1).tolist()
        if waiting and (null[0] or waiting[-1].column(0)[-1].as_py() != b.column(0)[0].as_py()):
            starts.insert(0, 0)
        for at in starts:
            if n + at - begin >= least:
                yield joined([*waiting, b.slice(begin, at - begin)])
                waiting, n, begin = [], 0, at
        waiting.append(b.slice(begin))
        n += b.num_rows - begin
    if n:
        yield joined(waiting)


Frequent = tuple[tuple[int, list[str], frozenset[str]], ...]  # worth of a pair in 25ths, the pairs


def frequent_pairs(keys: np.ndarray, texts: list[str], least: int = 3) -> dict[int, Frequent]:
    """Of sentences' letters: each key's pairs, formed inside sentences, met ``least`` times; those met n times are worth min(n, 5)."""
    n = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    if len(c) < 2:
        return {}
    letters = np.flatnonzero(np.bincount(c))
    rank = np.zeros(letters[-1] + 1, np.int64)
    rank[letters] = np.arange(len(letters))
    r, square = rank[c], len(letters) ** 2
    sentence = np.repeat(np.arange(len(n)), n)
    cell = (r[:-1] * len(letters) + r[1:] + keys.astype(np.int64)[sentence[:-1]] * square)[sentence[1:] == sentence[:-1]]
    if square * (int(keys.max()) + 1) <= 1 << 22:
        times = np.bincount(cell)
        cell = np.flatnonzero(times >= least)
        times = times[cell]
    else:
        cell, times = np.unique(cell, return_counts=True)
        cell, times = cell[times >= least], times[times >= least]
    found: dict[int, dict[int, list[str]]] = {}
    names: dict[int, str] = {}
    for key, pair, worth in zip((cell // square).tolist(), (cell % square).tolist(), np.minimum(times, 5).tolist(), strict=True):
        if pair not in names:
            names[pair] = chr(letters[pair // len(letters)]) + chr(letters[pair % len(letters)])
        found.setdefault(key, {}).setdefault(worth, []).append(names[pair])
    return {key: tuple((worth, t, frozenset(t)) for worth, t in lists.items()) for key, lists in found.items()}


def pair_worth(sentence: str, frequent: Frequent, short: int) -> int:
    """What a sentence's frequent pairs are worth: a short one is searched for each of them, a long one is cut into its own."""
    if len(sentence) <= short:
        return sum(25 * k * sum([t in sentence for t in tokens]) for k, tokens, _ in frequent)
    own = {sentence[i : i + 2] for i in range(len(sentence) - 1)}
    return sum(25 * k * len(own & tokens) for k, _, tokens in frequent)


def pairs_of(text: Column) -> Column:
    """All neighbouring pairs of characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


def bigrams(sentence_rows: DataFrame, key: str, letters: str = "一-龥", least: int = 3) -> DataFrame:
    """Letter pairs of each document, formed inside sentences after dropping all else, met ``least`` times."""
    kept = F.regexp_replace("sentence", f"[^{letters}]+", "")
    rows = sentence_rows.select(key, kept.alias("s")).filter(F.length("s") >= 2)
    rows = rows.select(key, F.explode(pairs_of(F.col("s"))).alias("token"))
    return rows.groupBy(key, "token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def scored_sentences(rows: DataFrame, key: str, domain=L.DOMAIN, letters: str = "一-龥", data: str = L.DATA_PATTERN, short: int = 400) -> DataFrame:
    """Add ``score`` (in hundredths, so that it is exact): domain words, frequent pairs, data, length, question.

    Sentences of a document come to one task, one after the other, and some documents at a time are held there.
    A short sentence is searched for each of its document's frequent pairs; one of over ``short`` characters
    is cut into its own pairs, which meet them by hashing.
    """
    ship(rows.sparkSession)
    names = [key, *(x for x in rows.columns if x != key)]
    kept = F.regexp_replace("sentence", f"[^{letters}]+", "").alias("_kept")
    kind = T.StructType([*(rows.schema[x] for x in names), T.StructField("_pairs", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            keys = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            null = b.column(0).is_null().to_pylist()  # rows without a key are of no document
            frequent = frequent_pairs(keys, ["" if t is None or none else t for t, none in zip(b.column("_kept").to_pylist(), null, strict=True)])
            found = [pair_worth(t or "", frequent.get(k, ()), short) for k, t in zip(keys.tolist(), b.column("sentence").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(found, pa.int64())], [*names, "_pairs"])

    out = rows.select(*names, kept).repartition(key).sortWithinPartitions(key).mapInArrow(run, kind).select(*rows.columns, "_pairs")
    s, n, pairs = F.col("sentence"), F.length("sentence"), F.col("_pairs")
    length = F.when(n.between(25, 70), 150).when(n < 15, -150).when(n > 110, -100).otherwise(0)
    score = X.count_hits(s, domain) * 160 + pairs + F.when(s.rlike(data), 220).otherwise(0) + length - F.when(F.rtrim(s).rlike("[？?]$"), 80).otherwise(0)
    return out.withColumn("score", score.cast("long")).drop("_pairs")


def letters_of(text: Column) -> Column:
    return F.array_distinct(F.split(text, ""))


def taken(ordered: Column, alike, limit: int | None = None) -> Column:
    """Texts of an ordered array, each unless it is alike to one taken, until ``limit``.

    ``alike`` compares (text, letters) of two; a text's letters are cut once and carried with it.
    """
    none = F.array().cast("array<struct<t:string,l:array<string>>>")
    new = lambda s, l: F.array(F.struct(s.alias("t"), l.alias("l")))
    kept = lambda a, s: X.bound(letters_of(s), lambda l: F.when(F.exists(a, lambda p: alike(s, l, p["t"], p["l"])), a).otherwise(F.concat(a, new(s, l))))
    step = kept if limit is None else lambda a, s: F.when(F.size(a) >= limit, a).otherwise(kept(a, s))
    return F.aggregate(ordered, none, step, lambda a: F.transform(a, lambda p: p["t"]))


def pick(ordered: Column, limit: int, most: float) -> Column:
    """Texts of an ordered array, each unless its letters are alike to one taken, until ``limit``."""

    def alike(s: Column, x: Column, r: Column, y: Column) -> Column:
        close = lambda both: both / (F.size(x) + F.size(y) - both) > most
        return (s != "") & (r != "") & X.bound(F.size(F.array_intersect(x, y)), close)

    return taken(ordered, alike, limit)


def key_points(scored: DataFrame, key: str, limit: int = 5, most: float = 0.62) -> DataFrame:
    """(key, pos, sentence): each document's best sentences that differ, with their places."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "sentence")))
    rows = scored.groupBy(key).agg(best.alias("_best"))
    rows = rows.withColumn("_kept", pick(F.transform("_best", lambda x: x["sentence"]), limit, most))
    first = F.transform("_kept", lambda s: F.filter("_best", lambda x: x["sentence"] == s)[0])
    return rows.select(key, F.inline(first)).select(key, "pos", "sentence")


def distilled(docs: DataFrame, key: str, title: str, text: str, domain=L.DOMAIN, letters: str = "一-龥", data: str = L.DATA_PATTERN, cases: str = L.CASE_PATTERN, promotion=L.PROMOTION, noise=L.NOISE_PHRASES, chapters=L.CHAPTERS) -> DataFrame:
    """Per document: thesis, key_points, key_data and cases, as far as its text has 50 characters."""
    # A text is cleaned once, by binding it: Spark would copy a filter's expression.
    cut = X.bound(without_noise(F.col(text), noise, chapters), lambda t: F.when(F.length(t) >= 50, sentences(t)))
    rows = scored_sentences(without_promotion(exploded(docs, key, cut), promotion), key, domain, letters, data)
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "sentence"))), lambda x: x["sentence"])
    plain = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    per = rows.groupBy(key).agg(best.alias("_best"), plain.alias("_all"))
    out = docs.select(key, F.col(title).alias("_title")).join(per, key, "left")
    tidy = lambda a: F.transform(a, lambda s: F.regexp_replace(s, "[，。；：]+$", ""))
    name = clean_title(F.coalesce("_title", F.lit("")))
    some = F.col("_best").isNotNull()
    return out.select(
        key,
        F.when(~some, "").when(F.length(name) >= 8, name).otherwise(F.regexp_replace(F.substring(F.element_at("_best", 1), 1, 60), "[，。；：、]+$", "")).alias("thesis"),
        F.when(some, pick(F.col("_best"), 5, 0.62)).alias("key_points"),
        F.when(some, tidy(pick(F.filter("_all", lambda s: s.rlike(data) & (F.length(s) <= 90)), 6, 0.7))).alias("key_data"),
        F.when(some, tidy(pick(F.filter("_all", lambda s: s.rlike(cases) & F.length(s).between(15, 120)), 3, 0.7))).alias("cases"),
    )


def clean_title(title: Column) -> Column:
    """Without what follows the first bar or dash to the last part, and a leading tag in brackets."""
    t = F.trim(F.regexp_replace(title, r"[|｜_–—]\s*[^|｜]*$", ""))
    return F.regexp_replace(F.regexp_replace(t, r"^[【\[（(][^】\])）]{0,10}[】\])）]\s*", ""), "[，。；：、:]+$", "")


def clean_transcript(text: Column, words: L.Speech = L.Speech()) -> Column:
    """No hashtags, fillers or doubled fillers; one line a sentence, each line once."""
    t = F.regexp_replace(text, rf"#[\p{{L}}\p{{N}}_]+", " ")
    t = F.regexp_replace(F.replace(t, F.lit("#"), F.lit(" ")), rf"([{words.repeated}])\1+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, f"[{words.ends}]", "\n"), f"({'|'.join(words.fillers)})", "")
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^[ ，,；;：:　]+|[ ，,；;：:　]+$", ""))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def is_garbage(text: Column, letters: str = "一-鿿") -> Column:
    t = F.trim(text)
    return (F.length(t) < 15) | (F.length(F.regexp_replace(t, f"[^{letters}]", "")) < 3)


def looks_like_lyrics(text: Column, words: L.Speech) -> Column:
    flat = F.regexp_replace(text, r"\s+", "")
    parts = F.filter(F.transform(F.split(text, r"[。！？!?\n,，]+", -1), lambda w: F.trim(w)), lambda s: F.length(s) >= 3)
    short = F.size(F.filter(parts, lambda s: F.length(s) <= 12))
    return (flat != "") & ((X.count_hits(flat, words.lyric) >= 3) | ((F.size(parts) >= 4) & (short * 100 >= F.size(parts) * 65)))


def duplicate_ratio(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[。！？!?\n]+", -1), lambda s: F.length(F.trim(s)) >= 5)
    return F.when(F.size(parts) >= 4, 1 - F.size(F.array_distinct(parts)) / F.size(parts)).otherwise(0.0)


def content_class(text: Column, title: Column, words: L.Speech = L.Speech()) -> Column:
    """lyrics, title_only or valid, in this order of tests."""
    t = F.trim(text)
    tags = r"#[\p{L}\p{N}_]+|#"
    flat = F.regexp_replace(F.regexp_replace(t, tags, " "), r"\s+", "")
    core = F.regexp_replace(F.coalesce(title, F.lit("")), rf"{tags}|\s+", "")
    return (
        F.when(X.has_any(F.lower(t), [m.lower() for m in words.markers]), "lyrics")
        .when(~X.has_any(t, words.domain) & looks_like_lyrics(t, words), "lyrics")
        .when((flat != "") & (core != "") & F.startswith(core, flat) & (F.length(flat) < 30), "title_only")
        .when(F.length(flat) < 15, "title_only")
        .when(duplicate_ratio(t) >= 0.4, "lyrics")
        .otherwise("valid")
    )


def script_sentences(text: Column, breaks=L.BREAKS) -> Column:
    """Sentences of a cleaned transcript; a long one without marks is cut before connectives, and near 50 letters."""
    strip = lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", ""), "^[ ，,；;：:　、]+|[ ，,；;：:　、]+$", "")
    plain = F.filter(F.transform(F.split(text, r"[。！？;.!?；\n]+", -1), strip), lambda s: F.length(s) >= 4)
    loose = (F.size(plain) <= 1) & (F.length(text) > 20) & ~text.rlike("[。！？.!?]")
    return F.when(loose, unpunctuated(text, breaks)).otherwise(plain)


def unpunctuated(text: Column, breaks=L.BREAKS, chunk: int = 50) -> Column:
    """Cut ahead of connectives; longer parts behind the last particle near ``chunk`` letters; short ones join."""
    words = "|".join(sorted(breaks, key=len, reverse=True))
    parts = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), f"(?={words})", -1), lambda p: p != "")

    def cut(rest: Column) -> Column:
        out = F.lit(chunk)
        for p in reversed(L.PARTICLES):
            area = F.substring(rest, chunk - 9, 15)
            at = F.length(area) - F.instr(F.reverse(area), p) + 1  # 1-based in the area
            place = F.when(F.instr(area, p) > 0, at + (chunk - 10))
            out = F.when(place.isNotNull() & (place - 1 > chunk // 2), place).otherwise(out)
        return out

    def chop(part: Column) -> Column:
        start = F.struct(part.alias("rest"), F.array().cast("array<string>").alias("out"))
        more = lambda a: F.length(a["rest"]) > chunk

        def step(a: Column, _: Column) -> Column:
            k = cut(a["rest"])
            done = F.struct(F.substring(a["rest"], k + 1, F.length(a["rest"])).alias("rest"), F.concat(a["out"], F.array(F.substring(a["rest"], F.lit(1), k))).alias("out"))
            return F.when(more(a), done).otherwise(a)

        rounds = F.sequence(F.lit(0), F.floor(F.length(part) / (chunk // 2)).cast("int"))
        return F.aggregate(rounds, start, step, lambda a: F.concat(a["out"], F.filter(F.array(a["rest"]), lambda s: s != "")))

    return F.filter(merged(F.flatten(F.transform(parts, chop)), 6), lambda s: F.length(s) >= 4)


def merged(parts: Column, least: int = 12) -> Column:
    """Parts under ``least`` letters join the one before."""
    none = F.array().cast("array<string>")
    join = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), s)))
    return F.aggregate(parts, none, lambda a, s: F.when((F.size(a) > 0) & (F.length(s) < least), join(a, s)).otherwise(F.concat(a, F.array(s))))


def distinct_sentences(parts: Column, most: float = 0.8) -> Column:
    """Each unless equal to a kept one, or sharing over ``most`` of the smaller letter set."""
    return taken(parts, lambda s, x, r, y: (s == r) | (F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) > most))


def paragraphs(parts: Column, most: int = 2, long: int = 90) -> Column:
    """Groups of up to ``most`` sentences or ``long`` letters, with commas inside and an end mark."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("buffer"), F.lit(0).alias("n"), empty.alias("out"))
    closed = lambda s: s.rlike("[。！？!?;；]$")

    def shut(buffer: Column) -> Column:
        one = F.element_at(buffer, 1)
        single = F.when(closed(one), one).when(X.has_any(one, L.QUESTIONS), F.concat(one, F.lit("？"))).otherwise(F.concat(one, F.lit("。")))
        many = F.concat(F.regexp_replace(F.array_join(buffer, "，"), "[，。、；：!?！？]+$", ""), F.lit("。"))
        return F.when(F.size(buffer) == 1, single).otherwise(many)

    def step(a: Column, s: Column) -> Column:
        buffer, n = F.concat(a["buffer"], F.array(s)), a["n"] + F.length(s)
        full = (F.size(buffer) >= most) | (n >= long)
        return F.when(full, F.struct(empty.alias("buffer"), F.lit(0).alias("n"), F.concat(a["out"], F.array(shut(buffer))).alias("out"))).otherwise(F.struct(buffer.alias("buffer"), n.alias("n"), a["out"].alias("out")))

    last = lambda a: F.when(F.size(a["buffer"]) > 0, F.concat(a["out"], F.array(shut(a["buffer"])))).otherwise(a["out"])
    return F.array_join(F.aggregate(parts, start, step, last), "\n\n")


def manuscript(text: Column, words: L.Speech = L.Speech()) -> Column:
    return paragraphs(merged(distinct_sentences(script_sentences(text, words.breaks))))


def transcript_job(rows: DataFrame, title: str, raw: str, words: L.Speech = L.Speech()) -> DataFrame:
    """Add transcript, outcome (garbage, lyrics, title_only, valid) and manuscript (empty unless valid)."""
    out = rows.withColumn("transcript", clean_transcript(F.coalesce(raw, F.lit("")), words))
    out = out.withColumn("outcome", F.when(is_garbage(F.col("transcript"), words.letters), "garbage").otherwise(content_class(F.col("transcript"), F.col(title), words)))
    return out.withColumn("manuscript", F.when(F.col("outcome") == "valid", manuscript(F.col("transcript"), words)).otherwise(""))
