"""Repair of conversation structure by the cheapest edits, with square-root checkpoints.

A well-formed conversation is an optional system turn and then pairs of user and assistant.
Its rows are numbered by a distributed sort and cut into blocks of about the square root of
its length. Backward costs of finishing from every state are kept at the ends of blocks
only: a block is a small min-plus matrix, and the matrices of a conversation are combined
from its end. Each block then recomputes its own cost vectors from its checkpoint and
walks forward along tight edits, always taking the first one in ASCII order. No task holds
more of a conversation than one block or one matrix per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import store
from bazarlytics.llm.lines import BLANKS
from bazarlytics.operators.ordering import number_rows

#: The costs of edits, what a truncated row adds unless deleted, and faults.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAULTS = ("", "truncated", "blank", "duplicate")
#: States: nothing yet, after system, after user, after assistant. The first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 50
END = [0, NEVER, NEVER, 0]
LEAST_BLOCK = 64


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after damage that their key's CRC-32 selects:
    drop, empty text, no end marks, repetition, or the role user. Nulls count as one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    changed = (
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return kept.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")


def _faults(text: Column) -> Column:
    """The place in FAULTS of a text by itself; repetition is seen elsewhere."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) == 0, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 1).otherwise(0)


def numbered_turns(rows: DataFrame) -> DataFrame:
    """g, conv, n, conv_id, turn, role, text and fault of every row, stored.

    g numbers all rows by conversation, turn (nulls first), role and text; conv is the first g
    of the row's conversation and n the number of its rows. A conversation of any length is
    sorted over many tasks; equal rows follow each other in any order.
    """
    given = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    ).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "salt")]
    placed = number_rows(given, order, "g").drop("salt").withColumn("fault", _faults(F.col("text")))
    sizes = placed.groupBy(F.col("conv_id").alias("of")).agg(F.min("g").alias("conv"), F.count("*").alias("n"))
    joined = store(placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"), "turns")
    hashed = joined.where("fault <> 2").select("g", "conv", "role", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2"))
    first = hashed.groupBy("conv", "role", "h", "h2").agg(F.min("g").alias("first"), F.count("*").alias("m")).where("m > 1")
    again = store(hashed.join(first, ["conv", "role", "h", "h2"]).where("g > first").select("g", F.lit(3).alias("again")), "repeated-turns")
    return store(joined.join(again, "g", "left").withColumn("fault", F.coalesce("again", "fault")).drop("again"), "faulty-turns")


def blocks(turns: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """conv, blk, first (its g), last (whether none follows) and syms of every block, in order.

    A sym is the role's place in "sua?" plus 4 for a truncated row and 8 for one that must go.
    """
    size = F.greatest(F.lit(least), F.ceil(F.sqrt("n")).cast("long"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    sym = role + 4 * F.least("fault", F.lit(2))
    rows = turns.select("conv", "g", "n", size.alias("size"), sym.cast("tinyint").alias("sym"))
    rows = rows.withColumn("blk", F.floor((F.col("g") - F.col("conv")) / F.col("size")))
    parts = rows.groupBy("conv", "blk", "size", "n").agg(F.array_sort(F.collect_list(F.struct("g", "sym"))).alias("rows"))
    return parts.select(
        "conv", "blk", (F.col("conv") + F.col("blk") * F.col("size")).alias("first"),
        ((F.col("blk") + 1) * F.col("size") >= F.col("n")).alias("last"),
        F.transform("rows", lambda r: r["sym"]).alias("syms"),
    )


def relaxed(v: list[int]) -> list[int]:
    """Costs from every state when turns may also be inserted first."""
    user, assistant = min(v[USER], v[ASSISTANT] + INSERT), min(v[ASSISTANT], v[USER] + INSERT)
    return [min(v[START], user + INSERT), min(v[SYSTEM], user + INSERT), user, assistant]


def before(sym: int, after: list[int]) -> list[int]:
    """Costs from every state in front of a row, given those behind it."""
    v = [x + DELETE for x in after]
    if sym < 8:
        role, extra = sym & 3, TRUNCATED if sym >= 4 else 0
        user, assistant = after[USER] + extra + (role != 1), after[ASSISTANT] + extra + (role != 2)
        v = [min(v[START], user), min(v[SYSTEM], user), min(v[USER], assistant), min(v[ASSISTANT], user)]
        if role == 0:
            v[START] = min(v[START], after[SYSTEM] + extra)
    return relaxed(v)


def matrix(syms: list[int]) -> list[int]:
    """Costs from every state at a block's begin to every state at its end, row by row."""
    columns = []
    for end in range(4):
        v = [NEVER] * 4
        v[end] = 0
        for sym in reversed(syms):
            v = before(sym, v)
        columns.append(v)
    return [columns[end][state] for state in range(4) for end in range(4)]


def applied(cells: list[int], after: list[int]) -> list[int]:
    """Costs at a block's begin from its matrix and those at its end."""
    return relaxed([min(cells[4 * s + e] + after[e] for e in range(4)) for s in range(4)])


def walk(syms: list[int], state: int, end: list[int], last: bool) -> tuple[int, list[tuple[str, int, int]]]:
    """The state at a block's end and its edits (letter, row or -1, state after): tight ones,
    the first in ASCII order each time. Only the last block inserts after its last row."""
    costs = [end]
    for sym in reversed(syms):
        costs.append(before(sym, costs[-1]))
    costs.reverse()
    i, out = 0, []
    while i < len(syms) or last and costs[i][state]:
        now, following = costs[i], costs[min(i + 1, len(syms))]
        filled = ASSISTANT if state == USER else USER
        sym = syms[i] if i < len(syms) else 8
        if i < len(syms) and now[state] == following[state] + DELETE:
            out.append(("D", i, state))
            i += 1
        elif now[state] == now[filled] + INSERT:
            out.append(("I", -1, filled))
            state = filled
        else:
            extra = TRUNCATED if sym >= 4 else 0
            stays = SYSTEM if sym & 3 == 0 and state == START else filled
            fits = stays == SYSTEM or sym & 3 == (1 if filled == USER else 2)
            keep = fits and now[state] == following[stays] + extra
            state = stays if keep else filled
            out.append(("K" if keep else "R", i, state))
            i += 1
    return state, out


def _checkpoints(parts: DataFrame) -> DataFrame:
    """conv, blk, ends (costs behind the block) and state (before it) for the blocks of
    conversations with several; per conversation one short row per block is brought together."""
    many = parts.where("not (last and blk = 0)")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [matrix(s) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.int64()))], ["conv", "blk", "cells"])

    def backward(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("blk", ascending=False)
        now, ends = relaxed(END), []
        for cells in frame["cells"]:
            ends.append(now)
            now = applied(cells.tolist(), now)
        return frame[["conv", "blk"]].assign(ends=ends)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, syms, ends = (b.column(i).to_pylist() for i in (2, 3, 4))
            out = [[walk(s, state, e, end)[0] for state in range(4)] for s, e, end in zip(syms, ends, last)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["conv", "blk", "exits"])

    def forward(frame: pd.DataFrame) -> pd.DataFrame:
        frame, states = frame.sort_values("blk"), [START]
        for step in frame["exits"]:
            states.append(int(step[states[-1]]))
        return frame[["conv", "blk"]].assign(state=states[:-1])

    cells = many.select("conv", "blk", "syms").mapInArrow(matrices, "conv long, blk long, cells array<long>")
    ends = store(cells.groupBy("conv").applyInPandas(backward, "conv long, blk long, ends array<long>"), "block-ends")
    steps = many.join(ends, ["conv", "blk"]).select("conv", "blk", "last", "syms", "ends")
    steps = steps.mapInArrow(exits, "conv long, blk long, exits array<int>")
    states = steps.groupBy("conv").applyInPandas(forward, "conv long, blk long, state int")
    return store(ends.join(states, ["conv", "blk"]), "checkpoints")


def edits(turns: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """conv, blk, seq, edit, state (after it) and g (null for an insertion), in order of blk, seq."""
    parts = store(blocks(turns, least), "turn-blocks")
    known = parts.join(_checkpoints(parts), ["conv", "blk"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = relaxed(END)
        for b in batches:
            out = [], [], [], [], [], []
            for conv, blk, first, last, syms, ends, state in zip(*(c.to_pylist() for c in b.columns)):
                for seq, (letter, row, after) in enumerate(walk(syms, state or START, ends or final, last)[1]):
                    for column, value in zip(out, (conv, blk, seq, letter, after, first + row if row >= 0 else None)):
                        column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["conv", "blk", "seq", "edit", "state", "g"])

    rows = known.select("conv", "blk", "first", "last", "syms", "ends", "state")
    return rows.mapInArrow(run, "conv long, blk long, seq int, edit string, state int, g long")


def repair(rows: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """Every edit of every conversation: conv, blk and seq give the order; edit is K, R, D or I;
    conv_id, turn, role and text are the row's, fault its first fault ("" for none), and
    new_role the role it has after the edit (null for a deleted row).

    Rows go by turn (nulls first); equal turns by role and text. Null roles and texts count as one
    space, rows without a conv_id as one conversation. Repeated rows are duplicates. An inserted row
    has no turn and an empty text. No rows give no rows. Other columns are ignored.
    """
    turns = numbered_turns(rows)
    found = store(edits(turns, least), "edits")
    role = F.when(F.col("edit") == "D", None).when(F.col("state") == SYSTEM, F.col("role"))
    role = role.when(F.col("edit") == "K", F.col("role")).when(F.col("state") == USER, "user").otherwise("assistant")
    fault = F.get(F.array(*map(F.lit, FAULTS)), F.col("fault"))
    named = [F.col(c) for c in ("conv", "blk", "seq", "edit", "conv_id", "turn", "role", "text")]
    own = found.where("g is not null").join(turns.drop("conv"), "g").select(*named, fault.alias("fault"), role.alias("new_role"))
    heads = turns.where("g = conv").select("conv", "conv_id")
    added = found.where("g is null").join(heads, "conv").withColumns(
        {"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit("")}
    )
    return own.union(added.select(*named, F.lit("").alias("fault"), role.alias("new_role")))


def repaired(found: DataFrame) -> DataFrame:
    """The rows that remain, in the order of conv, blk and seq: conv_id, role and text."""
    return found.where("new_role is not null").select("conv", "blk", "seq", "conv_id", F.col("new_role").alias("role"), "text")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Digest:
    """What is kept of one conversation while its edits pass by in order."""

    def __init__(self):
        self.counts, self.letters, self.sha, self.lines = dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), 0
        self.turns, self.low, self.high, self.initial = 0, None, None, None

    def add(self, edit: str, turn: int | None, role: str | None, text: str, fault: str, new_role: str | None) -> None:
        self.letters.append(edit)
        self.counts["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.initial = role[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if edit != "D":
            if fault == "truncated":
                self.counts["cost"] += TRUNCATED
            self.sha.update(f"{chr(10) if self.lines else ''}{new_role}:{text}".encode())
            self.lines += 1

    def row(self, conv: int) -> tuple:
        if self.turns:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        return conv, *(self.counts[c] for c in _COUNTS), "".join(self.letters), self.sha.hexdigest()


def digests(found: DataFrame) -> DataFrame:
    """conv, the counts, cost, audit and repaired_sha256 of every conversation of repair().

    A hash chains over a whole conversation, so one task reads its edits in order; it holds the
    letters of its audit and one batch of rows, whatever the length of the conversation.
    """
    names = ["conv", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for b in batches:
            for key, *values in zip(*(c.to_pylist() for c in b.columns)):
                if key != conv:
                    if now is not None:
                        done.append(now.row(conv))
                    conv, now = key, _Digest()
                now.add(*values)
            if len(done) > 5000:
                yield flush()
        if now is not None:
            done.append(now.row(conv))
        if done:
            yield flush()

    rows = found.repartition("conv").sortWithinPartitions("conv", "blk", "seq")
    schema = f"conv long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return rows.select("conv", "edit", "turn", "role", "text", "fault", "new_role").mapInArrow(run, schema)


def repair_digests(rows: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """conv_id, counts, cost, audit and repaired_sha256 of every conversation of the undamaged
    rows after damage and repair; one without rows after damage has zeros and empty strings."""
    found = store(repair(damage(rows), least), "repaired")
    heads = found.where("edit <> 'I' and blk = 0").groupBy("conv").agg(F.first("conv_id").alias("of"))
    digest = digests(found).join(heads, "conv")
    every = rows.select("conv_id").distinct()
    joined = every.join(digest, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
