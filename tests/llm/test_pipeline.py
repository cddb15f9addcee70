"""The pipeline's stages take effect, keep the columns and leave clean documents alone."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import decontaminate, neardup, secrets, toxicity
from inkwell.llm.common import new_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out()))
    left = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == want
        now = {r.doc_id: r.text for r in docs.collect()}
        gone = set(left) - set(now)
        assert set(now) <= set(left)
        if name == "toxicity":
            assert gone == {r.doc_id for r in toxicity.score(before, model).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            kept = {r.class_id for r in neardup.classes(before).collect()}
            assert set(now) == kept
        elif name == "decontamination":
            marked = decontaminate.annotate(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert gone == {r.doc_id for r in marked.filter("_dec_n_hit > 0").collect()}
        else:
            found = secrets.scan_versions(before, new_path(spark, "ledger"))
            assert not gone and {k for k in now if now[k] != left[k]} == {r.doc_id for r in found.collect() if r.secret_spans}
            assert all("[REDACTED]" in now[k] for k in now if now[k] != left[k])
        left = now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in left.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(left)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    plain, leaked, long = line(30), line(12), line(60_000)
    secret = f"{line(9)} token = abcdefgh12"
    texts = [
        (1, None), (2, ""), (2, ""), (3, plain), (3, plain), (4, plain), (None, plain), (5, long), (6, f"{line(3)} {leaked.upper()} {line(3)}"),
        (7, secret), (8, "short"), (None, "only a null id"), (9, "  \n "),
    ]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("theirs") for c in ("score", "predicted", "secret_spans", "ids", "hash", "band", "label", "_x")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leaked), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, d), name)
        assert now.columns == docs.columns
        rows = now.collect()
        assert all(r.score == r.predicted == r.secret_spans == r.ids == "theirs" for r in rows)
        left[name] = sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert len(left["toxicity"]) == len(texts)
    kept = [(1, None), (3, plain), (5, long), (6, texts[8][1]), (7, secret), (8, "short"), (None, "only a null id")]
    assert left["near_duplicates"] == sorted(kept, key=str) or left["near_duplicates"] == sorted([*kept, (9, "  \n ")], key=str)
    assert [r for r in left["near_duplicates"] if r[0] != 6] == left["decontamination"]
    masked = {i: t for i, t in left["secrets"]}
    assert masked[7].endswith("[REDACTED]") and {i: t for i, t in masked.items() if i != 7} == {i: t for i, t in left["decontamination"] if i != 7}
    out = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, now, d).collect()}
    assert {i: s for i, (_, s) in out.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in masked.items()}
    assert out[1][0] == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_secrets_are_masked(spark):
    docs = spark.createDataFrame([(1, "my token = abcdefgh12 ok", "en", "s", 24), (2, None, "en", "s", 0), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect()}
    assert got == {1: ("my [REDACTED] ok", 16), 2: (None, 0), 3: ("clean", 5)}
