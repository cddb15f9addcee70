"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for
the last returns the columns of documents:

1. toxicity: texts that the model calls toxic go;
2. near_duplicates: one document of each class stays, that with the least id;
3. decontamination: documents that hold a benchmark window go;
4. secrets: found secrets are masked in the text, and n_chars follows; no document goes;
5. bpe: each text is encoded and decoded; the result has a row a document.

Cases: null and empty texts are not toxic by themselves, are copies of each other (one row of
them stays), hold no window and no secret, and have no ids; of repeated rows (equal id and
text) one stays, of rows that tie in a class that with the least id, a null id last; texts of
any length are read whole; an empty table passes through all stages; further columns, also
those named as an operator's own, come through the first four stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontaminate, neardup, secrets, toxicity
from inkwell.llm.common import materialize, new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    marked = toxicity.score(docs, model, added=("_tox_score", "_tox_predicted"))
    return marked.filter("_tox_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents")
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(docs, new_path(spark, "ledger"), added="_led_spans")
    some = F.size("_led_spans") > 0
    text = F.when(some, secrets.redacted(F.col("text"), F.col("_led_spans"))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents")
    both = bpe.round_trip(docs.select("doc_id", "text"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode_and_decode),
]

#: SQL can express neither a trained model nor weighted sampling; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
