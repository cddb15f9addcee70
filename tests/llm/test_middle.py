"""Fill-in-middle against plain slicing, round trips, odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from inkwell.llm import middle
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "one line", "a\nb\nc\n", "\n", "\n\n\nx", "a <P> b\nc", "<<P\n>S>\n<", "é\U0001f600\nüber\n\nend", "no end\r\nnew\x0b\n x", "<\nP>\n<S\n>"]


def sliced(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def some(rng, size):
    """Texts of newlines, sentinels' letters and wide characters."""
    return ["".join(rng.choice(["\n", "\n", "<", ">", "P", "S", "M", "word ", "é", "\U0001f600"]) for _ in range(rng.randrange(size))) for _ in range(300)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (100, 100)])
def test_is_slicing_and_restores(spark, rate, spm):
    rng = random.Random(rate)
    rows = [*enumerate([*TEXTS, *some(rng, 40), "line of a long text\n" * 200_000]), (None, "a\nb\nc"), (5, "repeated\nid"), (5, "repeated\nid")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS form", "1 AS k", "'theirs' AS restored")
    made = middle.restore(middle.fill_in_middle(docs, rate=rate, spm=spm))
    got = made.collect()
    assert made.columns == ["doc_id", "text", "k", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = [(i, t, *sliced(i, t, rate, spm), t or "") for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got], key=key) == sorted(want, key=key)


def test_rotation_is_in_place():
    b = bytearray(b"xxABcdezz")
    same = b
    middle.rotate(b, 2, 4, 7)
    assert same is b and bytes(b) == b"xxcdeABzz"
    middle.rotate(b, 2, 5, 7)
    assert bytes(b) == b"xxABcdezz"


def test_query_and_sql(spark, tmp_path):
    rows = [*enumerate([*TEXTS, *some(random.Random(1), 60)]), (None, "a\nb"), (3, "a\nb\nc\n")]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS form").repartition(3).coalesce(1).write.parquet(f"{d}/d")
    part = next(p for p in (tmp_path / "d").iterdir() if p.suffix == ".parquet")
    part.rename(tmp_path / "documents.parquet")
    got = middle.op12_fill_in_middle(spark, d)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *(w := sliced(i, t))[:4], sha(w[4]), sha(t or "")) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert_same(got, middle.ORACLE, d)
