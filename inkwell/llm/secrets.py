"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every document is a (path columns, text) row. Its text is addressed by
SHA-256; the ledger, a Parquet table, records which rule versions have seen which blob and
what each of them found. A run scans only the pairs of blob and rule version that the ledger
lacks, once however many paths hold the blob, appends its findings and joins those of the
rule versions asked for, and of no others, to all paths.

Only DataFrame functions run: offsets come from the pieces between matches.

Cases: a null text is the empty text and has no findings; repeated rows share one blob and
each gets the findings; an empty table gives an empty result (and ledger); a blob that two
runs scanned at once counts once; other columns of the input pass through, but one with the
name of the added column is replaced; helper columns carry a ``_led_`` prefix so that they
clash with none of them. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import append, materialize, new_path, table


@dataclass(frozen=True)
class Rule:
    """Spans of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules.
BASE_RULES = (
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds of keys with a published shape.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: A span in the ledger, and in results: there with its rule's place among the rules asked for.
FOUND = "struct<start:int,kind:string,version:int,end:int>"
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
LEDGER = f"blob_id string, rules array<string>, spans array<{FOUND}>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_spans(df: DataFrame, text: str, rule: Rule, name: str) -> DataFrame:
    """Add ``name``: the rule's spans in the column ``text``."""
    found, parts, values, p = f"{name}_found", f"{name}_parts", f"{name}_values", F.lit(rule.pattern)
    df = df.withColumn(found, F.regexp_extract_all(text, p, F.lit(0)))
    some = F.size(found) > 0
    df = df.withColumn(parts, F.when(some, F.split(text, rule.pattern, -1)))
    df = df.withColumn(values, F.when(some, F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else F.col(found)))
    walk = f"""aggregate(sequence(0, size({found}) - 1),
        named_struct('pos', 0, 'out', cast(array() as array<{FOUND}>)),
        (a, i) -> named_struct(
            'pos', a.pos + char_length({parts}[i]) + char_length({found}[i]),
            'out', if(char_length({values}[i]) >= {rule.least}, array_append(a.out, named_struct(
                'start', a.pos + char_length({parts}[i]), 'kind', {_quoted(rule.kind)}, 'version', {rule.version},
                'end', a.pos + char_length({parts}[i]) + char_length({found}[i]))), a.out))).out"""
    none = F.expr(f"cast(array() as array<{FOUND}>)")
    return df.withColumn(name, F.when(some, F.expr(walk)).otherwise(none)).drop(found, parts, values)


def find_spans(df: DataFrame, text: str, rules: tuple[Rule, ...], todo: str | None = None) -> DataFrame:
    """Add ``_led_spans``: the spans of all rules. ``todo``: an array column of the rules to run in each row."""
    names = []
    for rank, rule in enumerate(rules):
        column = text
        if todo:
            column = f"_led_text{rank}"
            df = df.withColumn(column, F.when(F.array_contains(todo, rule.key), F.col(text)).otherwise(""))
        df = _with_spans(df, column, rule, name := f"_led_{rank}")
        names += [name]
        df = df.drop(column) if todo else df
    return df.withColumn("_led_spans", F.concat(*names)).drop(*names)


def _read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it and return the ledger.

    One row is kept of a blob (a partial aggregate, so that a blob with a third of all rows
    leaves each task once); then come one scan of each new blob and one append.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob_id"), body.alias("_led_body")).groupBy("blob_id").agg(F.first("_led_body").alias("_led_body"))
    every, todo = F.array(*[F.lit(r.key) for r in rules]), None
    if (ledger := _read_ledger(spark, ledger_path)) is not None:
        seen = ledger.groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("_led_seen"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("rules", F.when(F.col("_led_seen").isNull(), every).otherwise(F.array_except(every, "_led_seen")))
        blobs, todo = blobs.filter(F.size("rules") > 0), "rules"
    else:
        blobs = blobs.withColumn("rules", every)
    scanned = find_spans(blobs, "_led_body", rules, todo)
    append(scanned.select("blob_id", "rules", F.col("_led_spans").alias("spans")), ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def _asked_for(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of these rule versions, once each, in order of start, then place among the rules."""
    keys = F.array(*[F.lit(r.key) for r in rules]) if rules else F.array().cast("array<string>")

    def ranked(s: Column) -> Column:
        rank = F.array_position(keys, F.concat_ws("@", s["kind"], s["version"].cast("string"))).cast("int") - 1
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))

    return F.sort_array(F.array_distinct(F.filter(F.transform(spans, ranked), lambda s: s["rank"] >= 0)))


def scan_versions(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, text: str = "text", added: str = "secret_spans") -> DataFrame:
    """All rows of ``versions`` with the column ``added``: the spans of ``rules``, found now or on earlier runs.

    The last join meets a blob shared by very many paths: both its sides are plain
    exchanges, so adaptive execution can split that key. Blobs without findings stay out.
    """
    ledger = update_ledger(versions, ledger_path, rules, text)
    # The findings of a blob stand in one row for each run that scanned it.
    known = ledger.filter(F.size("spans") > 0).groupBy("blob_id").agg(F.flatten(F.collect_list("spans")).alias("_led_found"))
    known = known.select(F.col("blob_id").alias("_led_blob"), _asked_for(F.col("_led_found"), rules).alias("_led_found")).filter(F.size("_led_found") > 0)
    known = materialize(known, "findings")
    body = F.coalesce(F.col(text), F.lit(""))
    out = versions.drop(added).withColumn("_led_blob", F.sha2(body, 256)).join(known, "_led_blob", "left").drop("_led_blob")
    return out.withColumn(added, F.coalesce("_led_found", F.expr(f"cast(array() as array<{SPAN}>)"))).drop("_led_found")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, and overlapping ones together, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the base rules, then all; the second scans each blob for the rules it lacks only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    update_ledger(docs, ledger := new_path(spark, "ledger"), BASE_RULES)
    found = scan_versions(docs, ledger)
    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE_RULES))
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def _sql_kind(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""list_filter([{{'start': list_sum([0] || list_transform(range(1, i + 1), lambda j: len(p{rank}[j]))) + list_sum([0] || list_transform(range(1, i), lambda j: len(m{rank}[j]))),
      'rank': {rank}, 'kind': '{rule.kind}', 'stop': list_sum([0] || list_transform(range(1, i + 1), lambda j: len(p{rank}[j]) + len(m{rank}[j]))), 'value': len(g{rank}[i])}} for i in range(1, len(m{rank}) + 1)], lambda s: s.value >= {rule.least})"""


def _sql() -> str:
    cols = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        cols += [f"regexp_extract_all(t, '{p}') AS m{k}", f"regexp_extract_all(t, '{p}', {r.group}) AS g{k}", f"string_split_regex(t, '{p}') AS p{k}"]
    one = "list_transform({}, lambda s: s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.stop AS BIGINT))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(cols)} FROM d),
k AS (SELECT doc_id, {', '.join(f'{_sql_kind(r, k)} AS s{k}' for k, r in enumerate(RULES))} FROM m),
a AS (SELECT doc_id, s0, s1, s2, list_sort(s0 || s1 || s2) AS base, list_sort({' || '.join(f's{k}' for k in range(len(RULES)))}) AS every FROM k)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
  sha256(array_to_string({one.format('base')}, ',')) AS base_sha256, array_to_string({one.format('every')}, ',') AS spans FROM a"""


ORACLE = _sql()
