"""Conversation repair against plain enumeration and a plain recursion, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash

from inkwell.llm import dialogues
from inkwell.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def enumerated(rows, marks):
    """Cheapest edits by trying all of them, with up to two inserts in a gap."""
    best = None
    ways = [["D"] if m in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for m in marks]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*ways):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, initials = 5 * len("".join(put)), "I" * len(put[0]), put[0]
            for (role, _), mark, edit, after in zip(rows, marks, edits, put[1:], strict=True):
                cost += {"K": 0, "R": 1, "D": 2}[edit[0]] + (5 if mark == "truncated" and edit != "D" else 0)
                audit += edit[0] + "I" * len(after)
                initials += ("" if edit == "D" else (role[:1] or "-") if edit == "K" else edit[1]) + after
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(best or (cost, audit), (cost, audit))
    return best


def plainly(rows, marks):
    """Cheapest edits by a recursion over pairs (cost, letters) from the end."""
    to = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for (role, _), mark in zip(reversed(rows), reversed(marks), strict=True):
        extra, new = 5 if mark == "truncated" else 0, {}
        for s in to:
            ways = [(best[s][0] + 2, "D" + best[s][1])]
            if mark not in ("blank", "duplicate"):
                ways.append((best[to[s]][0] + 1 + extra, "R" + best[to[s]][1]))
                if role[:1] == to[s] or (role[:1] == "s" and s == ""):
                    ways.append((best[role[:1]][0] + extra, "K" + best[role[:1]][1]))
            new[s] = min(ways)
        one = {s: (new[to[s]][0] + 5, "I" + new[to[s]][1]) for s in to}
        two = {s: (one[to[s]][0] + 5, "I" + one[to[s]][1]) for s in to}
        best = {s: min(new[s], one[s], two[s]) for s in to}
    return best[""]


def rebuilt(rows, audit):
    out, k, state = [], 0, ""
    for letter in audit:
        role = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((role, ""))
        else:
            k += 1
            if letter != "D":
                out.append((rows[k - 1][0] if letter == "K" else role, rows[k - 1][1]))
        state = out[-1][0][:1] if out else ""
    assert k == len(rows)
    return out


def hashed(text):
    return int.from_bytes(xxhash.xxh64_digest(text.encode(), seed=42), "big", signed=True)


def expected(table):
    """What the query must return, by plain loops."""
    by = {}
    for conv, turn, role, text in table:
        held = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashed(r[2])))
        turns = {t for t, _, _ in held} - {None}
        rows = [r[1:] for r in held]
        marks = faults(rows)
        cost, audit = plainly(rows, marks)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        fixed = rebuilt(rows, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def answered(spark, table, tmp_path, parts=3):
    d = str(tmp_path / "in")
    spark.createDataFrame(table, SCHEMA).repartition(parts).selectExpr("*", "1 AS place", "2 AS block", "'x' AS audit").write.parquet(f"{d}/conversations.parquet")
    got = dialogues.op11_conversation_repair(spark, d).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits_are_those_of_all(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["", "a.", "b", "c?"])) for _ in range(rng.randrange(5))]
    marks = faults(rows)
    facts = [(r[:1], m in ("blank", "duplicate"), m == "truncated") for (r, _), m in zip(rows, marks, strict=True)]
    want = enumerated(rows, marks)
    assert plainly(rows, marks) == want
    for cuts in ([], [1], [2], [1, 2, 3]):
        at = [0, *[c for c in cuts if c < len(rows)], len(rows)]
        assert dialogues.folded([dialogues.table_of_block(facts[a:b]) for a, b in itertools.pairwise(at)]) == want


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("costs", [dialogues.COSTS, dialogues.Costs(3, 9, 2, 1), dialogues.Costs(4, 4, 1, 0)])
def test_blocks_fold_to_the_same_edits(seed, costs):
    """Also with costs under which inserting pays."""
    rng = random.Random(seed)
    facts = [(rng.choice("uasx"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(60)]
    whole = dialogues.folded([dialogues.table_of_block(facts, costs)], costs)
    assert whole == dialogues.folded([dialogues.table_of_block(facts[k : k + 7], costs) for k in range(0, 60, 7)], costs)
    if costs.insert < costs.delete:
        assert "I" in whole[1]


def some_table(rng, convs, most):
    table = []
    for c in convs:
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""])
            text = rng.choice(["Yes.", "No!", "why?", "cut", "", " \n\t", None, f"one {t}.", "é\U0001f600?  "])
            table.append((c, rng.choice([t, t, t, t, None, 3 * t, -t]), role, text))
    return table


def test_query_is_the_plain_one(spark, tmp_path):
    table = some_table(random.Random(3), [None, *range(150)], 12)
    assert answered(spark, table, tmp_path) == expected(table)


def test_long_conversation_spans_blocks_and_partitions(spark, tmp_path):
    """One conversation holds most rows, many of them equal; others stand around it."""
    rng = random.Random(4)
    table = some_table(rng, [1, 2, 9], 9)
    table += [(5, k // 2, rng.choice(["user", "assistant"]), rng.choice(["same text.", f"turn {k}.", "cut off"])) for k in range(3000)]
    assert answered(spark, table, tmp_path) == expected(table)


def test_odd_and_empty(spark, tmp_path):
    assert answered(spark, [], tmp_path / "none") == {}
    gone = [(c, t, "user", "x.") for c in range(40) for t in (0,)]
    want = expected(gone)
    assert answered(spark, gone, tmp_path / "gone") == want
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert empty in want.values()
    long = [(7, 1, "user", "word " * 100_000 + "."), (7, 2, "assistant", "reply."), (7, None, None, None), (None, None, None, None)]
    assert answered(spark, long, tmp_path / "long") == expected(long)


def test_repaired_rows(spark):
    table = [(1, 1, "user", "one."), (1, 2, "user", "two."), (1, 3, "assistant", "three."), (2, 1, "system", "s."), (2, 2, "tool", "t."), (2, 3, "assistant", "ok.")]
    scratch = Scratch(spark)
    places = dialogues.ordered(spark.createDataFrame(table, SCHEMA), scratch)
    found = scratch.write("found", dialogues.diagnosed(places))
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (2, "DKK"), 2: (1, "KRK")}
    rows = [tuple(r) for r in dialogues.repaired(places, found).orderBy("conv_id", "pos").collect()]
    assert rows == [(1, 0, "user", "two.", "K"), (1, 1, "assistant", "three.", "K"), (2, 0, "system", "s.", "K"), (2, 1, "user", "t.", "R"), (2, 2, "assistant", "ok.", "K")]
