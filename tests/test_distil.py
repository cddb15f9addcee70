"""Scores of sentences in one pass against a plain loop; texts are cut once."""

from __future__ import annotations

import collections
import random
import re

import pyarrow as pa

from inkwell.operators import distil


def loop(rows, letters):
    times = collections.Counter()
    for k, _, s in rows:
        kept = re.sub(f"[^{letters}]+", "", s)
        times.update((k, kept[i : i + 2]) for i in range(len(kept) - 1) if k is not None)
    out = []
    for k, pos, s in rows:
        pairs = sum(25 * min(n, 5) for (key, t), n in times.items() if n >= 3 and key == k and t in s)
        length = 150 if 25 <= len(s) <= 70 else -150 if len(s) < 15 else -100 if len(s) > 110 else 0
        out.append((k, pos, pairs + length))
    return sorted(out, key=str)


def test_scores_are_the_loop_for_every_key(spark):
    rng = random.Random(3)
    letters = "a-d\U0001f600-\U0001f602"
    word = lambda: "".join(rng.choice("abcd \U0001f600\U0001f601.") for _ in range(rng.randrange(8, 90)))
    rows = [(rng.choice([None, *range(30)]), k, word()) for k in range(600)] + [(77, k, word() * 8) for k in range(1500)]
    for key in ("long", "string"):
        df = spark.createDataFrame(rows, "k long, pos int, sentence string").selectExpr(f"CAST(k AS {key}) AS k", "pos", "sentence")
        got = distil.scored_sentences(df.repartition(5), "k", ("zz",), letters, "99")
        assert got.columns == ["k", "pos", "sentence", "score"]
        assert sorted(((None if r.k is None else int(r.k), r.pos, r.score) for r in got.collect()), key=str) == loop(rows, letters)


def test_keys_stay_whole_and_nulls_do_not_gather():
    keys = [None] * 9 + [1, 1, 2, 3, 3, 3, 3, 3, 4]
    table = pa.table({"k": pa.array(keys, pa.int64()), "n": list(range(len(keys)))})
    for size in (1, 2, 5, 100):
        for least in (1, 3, 100):
            parts = [b.to_pydict() for b in distil.whole_keys(iter(table.to_batches(max_chunksize=size)), least)]
            assert [x for p in parts for x in p["n"]] == list(range(len(keys)))
            for k in (1, 2, 3, 4):
                assert sum(k in p["k"] for p in parts) == 1
            assert all(p["k"].count(None) <= max(least, 1) for p in parts)


def test_a_text_is_cleaned_and_cut_once(spark):
    docs = spark.createDataFrame([(1, "a title", "A text of one sentence that is long enough to be kept whole.")], "id long, title string, text string")
    plan = distil.distilled(docs, "id", "title", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[①-⑩]") == 1
