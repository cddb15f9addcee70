"""Quality rules: a decision list learned by sequential covering.

Text statistics are DataFrame expressions. From those of labelled rows, the learner grows
one conjunction of thresholds after another that singles out low-quality rows, prunes each
on held-out rows, sets covered rows aside and goes on. The list becomes one ordered Spark
CASE expression, applied to every row.

The labelled rows used for fitting are bounded by ``most_labels`` (those with the smallest
hash of their id); statistics and verdicts cover every row and whole texts. Only DataFrame
functions run on the executors.

Cases: null and empty texts have no words and fail the base rules; rows whose label is null
or missing are not learned from; an empty label table gives an empty list, so the base rules
alone decide; ids that repeat are learned from repeatedly and each row is judged by its text
alone. Helper columns start with ``_q_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import table

SYMBOLS, BLANKS, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
MOST_LABELS = 4000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of COUNTS and the shares that rules may test.

    Windows of eight words are compared by a 64-bit hash of their words; only texts in which
    a hash repeats are looked at again, by sorting the hashes with their places.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_q_text", body)
    df = df.withColumn("_q_words", F.filter(F.split("_q_text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_q_words").cast("long"))
    hashes = f"""CASE WHEN size(_q_words) >= {WINDOW} THEN transform(sequence(0, size(_q_words) - {WINDOW}),
        i -> xxhash64({', '.join(f'_q_words[i + {k}]' for k in range(WINDOW))})) ELSE cast(array() as array<bigint>) END"""
    lines = F.filter(F.split("_q_text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    df = df.withColumn("_q_windows", F.expr(hashes)).withColumn("_q_lines", lines)
    df = df.withColumn("_q_sorted", F.expr("""CASE WHEN size(array_distinct(_q_windows)) < size(_q_windows)
        THEN sort_array(transform(_q_windows, (h, i) -> named_struct('h', h, 'i', i))) END"""))
    df = df.withColumn("_q_places", F.expr("""sort_array(transform(filter(_q_sorted, (x, j) ->
        (j > 0 AND _q_sorted[greatest(j - 1, 0)].h = x.h) OR (j < size(_q_sorted) - 1 AND _q_sorted[least(j + 1, size(_q_sorted) - 1)].h = x.h)), x -> x.i))"""))
    df = df.withColumn("n_repeat_words", F.expr(f"""coalesce(aggregate(transform(_q_places, (p, j) ->
        CASE WHEN j = size(_q_places) - 1 THEN {WINDOW} ELSE least({WINDOW}, _q_places[least(j + 1, size(_q_places) - 1)] - p) END),
        0L, (a, x) -> a + x), 0L)"""))
    df = df.withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate("_q_text", BLANKS, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    df = df.withColumn("_q_n_lines", F.size("_q_lines")).withColumn("_q_digits", F.length("_q_text") - F.length(F.translate("_q_text", "0123456789", "")))
    df = df.withColumn("_q_unique", F.size(F.array_distinct("_q_words")))
    df = df.withColumn("word_length", share("word_chars", "n_words")).withColumn("symbol_share", share("n_symbols", "word_chars"))
    df = df.withColumn("dup_line_share", share("n_dup_lines", "_q_n_lines")).withColumn("repeat_share", share("n_repeat_words", "n_words"))
    df = df.withColumn("digit_share", share("_q_digits", "word_chars")).withColumn("unique_share", share("_q_unique", "n_words"))
    return df.drop(*[c for c in df.columns if c.startswith("_q_")])


FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "unique_share")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


@dataclass(frozen=True)
class ListedRule:
    tests: tuple[Test, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out


def learn(rows: list[tuple], features: tuple[str, ...] = FEATURES, cuts: int = 24, least_precision: float = 0.9, least_cover: int = 8, most_tests: int = 3, most_rules: int = 12) -> list[ListedRule]:
    """Sequential covering over rows (features..., bad: 0 or 1), a bounded sample.

    Sets of rows are integers used as bit sets. Two thirds of the rows grow rules, the
    others prune them; a rule stays if it is precise on both.
    """
    if not rows:
        return []
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    everyone = (1 << len(rows)) - 1
    bad = sum(1 << i for i, r in enumerate(rows) if r[-1])
    masks: dict[Test, int] = {}
    for k, name in enumerate(features):
        values = sorted({r[k] for r in rows})
        for v in sorted({values[(len(values) - 1) * q // cuts] for q in range(cuts + 1)}):
            high = sum(1 << i for i, r in enumerate(rows) if r[k] > v)
            masks[Test(name, True, float(v))] = high
            masks[Test(name, False, float(v))] = everyone & ~high
    left, rules = everyone, []

    def value(m: int) -> tuple[float, int]:
        n = m.bit_count()
        return ((m & bad).bit_count() + 0.5) / (n + 1), n

    while len(rules) < most_rules:
        tests: list[Test] = []
        now = left & grow
        while len(tests) < most_tests:
            score = lambda m: ((m & bad).bit_count() * (value(m)[0] - value(now)[0]))  # noqa: E731, B023
            best = max(masks, key=lambda t: (score(masks[t] & now), t.feature, t.above, -t.value))
            if score(masks[best] & now) <= 0:
                break
            tests.append(best)
            now &= masks[best]
            if value(now)[0] >= 0.99:
                break

        def held(ts: list[Test]) -> tuple[float, int]:
            m = left & ~grow
            for t in ts:
                m &= masks[t]
            return value(m)

        while len(tests) > 1:  # prune: leave out what held-out rows don't need
            without = max(([t for t in tests if t is not out] for out in tests), key=held)
            if held(without)[0] < held(tests)[0]:
                break
            tests = without
        cover = left
        for t in tests:
            cover &= masks[t]
        precision, n = value(cover)
        if not tests or n < least_cover or precision < least_precision:
            break
        rules.append(ListedRule(tuple(tests), precision, n))
        left &= ~cover
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labels: int = MOST_LABELS) -> list[tuple]:
    """At most ``most_labels`` labelled rows, those with the least hash of their id: statistics and whether they are bad.

    Their ids are few by that bound, so they are broadcast and the other texts are never analysed here.
    """
    least = F.xxhash64("doc_id", F.lit("quality"))
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    ids = ids.orderBy(least, "doc_id", label).limit(most_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = with_statistics(rows).orderBy(least, "doc_id", *FEATURES, label).limit(most_labels).orderBy("doc_id", *FEATURES, label)
    return [tuple(r) for r in rows.select(*FEATURES, (F.col(label) == 0).cast("int")).collect()]


def verdict(rules: list[ListedRule]) -> Column:
    """Keep (true) unless a listed rule, tried in order, says otherwise."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = with_statistics(docs).withColumn("base_failed", base_failed())
    return scored.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
