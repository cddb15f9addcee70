"""Conversation structure repair: the cheapest edits that make turns alternate.

The rows of a conversation, in order of turn, may be kept, get another role, be deleted, and
rows may be inserted; the roles that come out read as an optional system row and pairs of
user and assistant, or nothing. A list of edits weighs one big integer: its high digits are
the cost, its low ones, a fixed number of octal digits, the audit's letters from the left with
zeros at the end. The least integer is therefore the cheapest list and, of equal cost, the one
whose letters come first in ASCII; a shortest-path recursion over (row, state) needs no other
comparison. There is no cycle: more than two inserts in one gap come back to a state that was
there for less.

A conversation may hold a large share of all rows, so none is gathered. Rows are sorted by
range once and written with their place; each block of ``BLOCK`` places gives, for each of its
conversations, the least integers from every state before the block to every state after it,
and these small tables are folded, from the last to the first, a conversation. First
occurrences come from a partial minimum of places, and each meets its row inside its block.
Only the repaired rows (and a digest of them) run through one task a conversation, in order
and in a stream, beside its audit.

Cases: nulls are read as one space, in ids of the damage's key, roles and texts (the id that
comes out stays null, and null ids are one conversation); a null turn comes first; rows that
tie in turn come by role, then by their text's hash; repeated rows are duplicates but the first; an empty or
white text is blank, whatever else it is; an empty role stands nowhere, so its row goes or
gets a role; a conversation without rows costs nothing and has
an empty audit; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.llm.common import Scratch, returning_memory, table

WHITE = " \t\n\x0b\x0c\r"
#: Places of one block, as bits; and what edits cost.
BLOCK = 8
SCHEMA = "conv_id {0}, n long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


COSTS = Costs()

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The state that a row of user or assistant leads to, and the role that it must have.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")
DIGITS = str.maketrans("DIKR", "1234")
LETTERS = str.maketrans("1234", "DIKR")


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial and initial == ROLE[state][0] else None


# --- Weights: cost in high digits, letters in ``width`` low ones ---------------------------


def weight(cost: int, audit: str, width: int) -> int:
    return cost << 3 * width | int(audit.translate(DIGITS).ljust(width, "0") or "0", 8)


def unweighed(w: int, width: int) -> tuple[int, str]:
    low = w & (1 << 3 * width) - 1
    return w >> 3 * width, f"{low:o}".zfill(width).rstrip("0").translate(LETTERS)


Fact = tuple[str, bool, bool]
Way = tuple[int, str]


def ends(costs: Costs = COSTS) -> list[Way | None]:
    """What follows the last row, from each state."""
    return [(0, ""), (2 * costs.insert, "II"), (costs.insert, "I"), (0, "")]


def cheapest(rows: list[Fact], after: list[Way | None], costs: Costs = COSTS) -> list[Way | None]:
    """From each state the cheapest edits of rows (initial, must go, truncated), and of what follows them; inserts stand before rows."""
    width = 3 * len(rows) + max(len(x[1]) for x in after if x)
    bits, top = 3 * width, 3 * (width - 1)
    mask = (1 << bits) - 1

    def led(w: int | None, cost: int, digit: int) -> int | None:
        return None if w is None else (w >> bits) + cost << bits | digit << top | (w & mask) >> 3

    def least(*some: int | None) -> int | None:
        return min((w for w in some if w is not None), default=None)

    best = [None if x is None else weight(*x, width) for x in after]
    for initial, must_go, truncated in reversed(rows):
        extra = costs.truncated if truncated else 0
        gone = [led(w, costs.delete, 1) for w in best]
        if not must_go:
            for s in STATES:
                stays = kept_state(s, initial)
                gone[s] = least(gone[s], None if stays is None else led(best[stays], extra, 3), led(best[NEXT[s]], costs.rerole + extra, 4))
        once = [led(gone[NEXT[s]], costs.insert, 2) for s in STATES]
        twice = [led(once[NEXT[s]], costs.insert, 2) for s in STATES]
        best = [least(gone[s], once[s], twice[s]) for s in STATES]
    return [None if w is None else unweighed(w, width) for w in best]


def table_of_block(rows: list[Fact], costs: Costs = COSTS) -> list[Way | None]:
    """The cheapest edits of rows for each pair (state before, state after)."""
    by_end = [cheapest(rows, [(0, "") if s == after else None for s in STATES], costs) for after in STATES]
    return [by_end[after][before] for before in STATES for after in STATES]


def table_of_whole(rows: list[Fact], costs: Costs = COSTS) -> list[Way | None]:
    """The same of a conversation that has no other rows: the one pair that counts, with what follows."""
    return [cheapest(rows, ends(costs), costs)[START], *[None] * (len(STATES) ** 2 - 1)]


def folded(tables: list[list[Way | None]], costs: Costs = COSTS) -> Way:
    """The cheapest edits of a conversation from its blocks' tables, in order."""
    rest = ends(costs)
    for cells in reversed(tables):
        width = max((len(c[1]) for c in cells if c), default=0) + max(len(r[1]) for r in rest if r)
        new: list[Way | None] = []
        for before in STATES:
            ways = [weight(c[0] + r[0], c[1] + r[1], width) for c, r in zip(cells[4 * before : 4 * before + 4], rest, strict=True) if c and r]
            new.append(unweighed(min(ways), width) if ways else None)
        rest = new
    return rest[START]


# --- Rows in order ---------------------------------------------------------------------------


def plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults that a checksum of conversation and turn decides."""
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return out.filter("kind <> 0").select("conv_id", "turn", "role", "text", times.alias("_copy")).drop("_copy")


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their ``place``: greater places come later in the order (conversation, turn, role, hash of the text)."""
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"))
    rows = rows.withColumns({"_said": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_said", "_row"]  # the driver draws ranges from a sample of keys
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_said", "_row")
    return scratch.write("ordered", ranges.withColumn("place", F.monotonically_increasing_id()))


def blocks(places: DataFrame) -> DataFrame:
    """One row a block: its rows' facts and which of its places hold a role and text for the first time."""
    bare = F.rtrim("text", F.lit(WHITE))
    facts = places.select(
        "conv_id", "place", F.col("turn").cast("string").alias("turn"), F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "role", F.unhex(F.sha2("text", 256)).alias("said"))
    block = F.shiftright("place", BLOCK)
    first = facts.groupBy("conv_id", "role", "said").agg(F.min("place").alias("place"))
    first = first.groupBy(block.alias("block")).agg(F.collect_list("place").alias("first"))
    fields = F.struct("place", "conv_id", "turn", "initial", "blank", "truncated")
    return facts.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(fields)).alias("rows")).join(first, "block", "left")


def _tables(kind: pa.DataType):
    names = ("conv_id", "block", "n", "blank", "duplicate", "truncated", "illegal", "turns", "lowest", "highest", "left", "right", "cells")
    cell = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema(list(zip(names, [kind, *[pa.int64()] * 7, *[pa.string()] * 4, cell], strict=True)))  # a conversation inside a block, neither first nor last, is whole

    def one(block: int, conv, rows: list[dict], first: set[int], whole: bool) -> tuple:
        again = [not r["blank"] and r["place"] not in first for r in rows]
        cut = [r["truncated"] and not r["blank"] and not d for r, d in zip(rows, again, strict=True)]
        facts = [(r["initial"], r["blank"] or d, c) for r, d, c in zip(rows, again, cut, strict=True)]
        cells = table_of_whole(facts) if whole else table_of_block(facts)
        initials, turns = [r["initial"] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]
        illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
        cells = [c and {"cost": c[0], "audit": c[1]} for c in cells]
        ends = (turns[0], turns[-1]) if turns else (None, None)
        return conv, block, len(rows), sum(r["blank"] for r in rows), sum(again), sum(cut), illegal, len(set(turns)), *ends, initials[0], initials[-1], cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):
                found = []
                for r in b.slice(i, 16).to_pylist():
                    first = set(r["first"] or ())
                    parts = [(conv, list(rows)) for conv, rows in itertools.groupby(r["rows"], lambda x: x["conv_id"])]
                    found += [one(r["block"], conv, rows, first, 0 < k < len(parts) - 1) for k, (conv, rows) in enumerate(parts)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=schema)

    return returning_memory(run)


def _solved(parts: list[dict]) -> tuple:
    """A conversation's sums and repair from its blocks in order."""
    turns = [p for p in parts if p["lowest"] is not None]
    distinct = sum(p["turns"] for p in turns) - sum(p["highest"] == q["lowest"] for p, q in itertools.pairwise(turns))
    gaps = int(turns[-1]["highest"]) - int(turns[0]["lowest"]) + 1 - distinct if turns else 0
    illegal = sum(p["illegal"] for p in parts) + sum(p["right"] + q["left"] not in LEGAL for p, q in itertools.pairwise(parts))
    cost, audit = folded([[c and (c["cost"], c["audit"]) for c in p["cells"]] for p in parts])
    n, *faults = [sum(p[k] for p in parts) for k in ("n", "blank", "duplicate", "truncated")]
    return n, gaps, *faults, illegal, cost, audit


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 7, pa.string()]
    names = ["conv_id", "n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for b in batches:
        for i in range(0, b.num_rows, 64):
            g = b.slice(i, 64)
            columns = zip(*[_solved(parts) for parts in g.column(1).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([g.column(0), *[pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]], names)


def diagnosed(places: DataFrame) -> DataFrame:
    """One row a conversation: its rows, gaps in turns, faults, illegal neighbours, cost and audit of its repair."""
    kind = dict(places.dtypes)["conv_id"]
    cells = "array<struct<cost:long,audit:string>>"
    schema = f"conv_id {kind}, block long, n long, blank long, duplicate long, truncated long, illegal long, turns long, lowest string, highest string, `left` string, `right` string, cells {cells}"
    tables = blocks(places).mapInArrow(_tables(_arrow(places, "conv_id")), schema)
    parts = tables.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in tables.columns if c != "conv_id"]))).alias("blocks"))
    return parts.mapInArrow(returning_memory(_solve), SCHEMA.format(kind))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


# --- Repaired rows -----------------------------------------------------------------------------


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, role, text, letter) of repaired rows; each conversation's rows follow its audit.

    After the last row of one, its remaining inserts come; a pair (conversation, None, None,
    None) opens each, so that one without rows is seen as well.
    """
    letters, state, conv = "", START, None
    at = 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            yield conv, ROLE[state], "", "I"
            at, state = at + 1, NEXT[state]

    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            for key, audit, role, text in zip(*[part.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")], strict=True):
                if audit is not None:
                    yield from inserts()
                    letters, state, conv, at = audit, START, key, 0
                    yield conv, None, None, None
                    continue
                yield from inserts()
                edit, at = letters[at], at + 1
                if edit == "D":
                    continue
                role = ROLE[state] if edit == "R" else role
                yield conv, role, text, edit
                state = SYSTEM if role[:1] == "s" else NEXT[state]
    yield from inserts()


def _stream(places: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of all conversations, each one's in order behind its audit, whole conversations in a partition."""
    rows = places.select("conv_id", "place", F.lit(None).cast("string").alias("audit"), "role", "text")
    nothing = F.lit(None).cast("string")
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), "audit", nothing.alias("role"), nothing.alias("text"))
    return heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired(places: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of repaired conversations: conv_id, pos, role, text and the edit (K, R or I) that made them."""
    kind = _arrow(places, "conv_id")
    schema = pa.schema([("conv_id", kind), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pos = [], 0
        for conv, role, text, edit in _repaired(batches):
            if edit is None:
                pos = 0
                continue
            held.append({"conv_id": conv, "pos": pos, "role": role, "text": text, "edit": edit})
            pos += 1
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return _stream(places, audits).mapInArrow(returning_memory(run), f"conv_id {dict(places.dtypes)['conv_id']}, pos long, role string, text string, edit string")


def digests(places: DataFrame, audits: DataFrame) -> DataFrame:
    """SHA-256 a conversation of its repaired rows, ``role:text`` joined by newlines, without writing them."""
    schema = pa.schema([("conv_id", _arrow(places, "conv_id")), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, sha, between = [], None, None, b""
        for key, role, text, edit in _repaired(batches):
            if edit is None:
                if sha:
                    held.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                conv, sha, between = key, hashlib.sha256(), b""
                if len(held) == 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
                continue
            sha.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            between = b"\n"
        if sha:
            held.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return _stream(places, audits).mapInArrow(returning_memory(run), f"conv_id {dict(places.dtypes)['conv_id']}, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule: faults found, cost and audit of its repair, digest of what comes out."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark)
    places = ordered(damaged(given), scratch)
    found = scratch.write("diagnosed", diagnosed(places))
    made = scratch.write("digests", digests(places, found))
    scratch.drop("ordered")
    every = given.select(F.col("conv_id").alias("_id")).distinct()
    made = made.withColumnRenamed("conv_id", "_made")
    out = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(made, F.col("_id").eqNullSafe(F.col("_made")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
