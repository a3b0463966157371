import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from bazarlytics.llm import conversations as C
from bazarlytics.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Dijkstra over (row, state) by (cost, audit): the first goal reached has the least audit."""
    state_of = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("", "s"): "s", ("u", "a"): "a"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (to := state_of.get((state, role[0]))) is not None:
                heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*out, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for letter, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (to := state_of.get((state, new[:1]))) is not None:
                        heapq.heappush(queue, (cost + price + extra, audit + letter, i + 1, to, (*out, (new, text))))


def brute(rows):
    out = {conv: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    after = sorted(damaged(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))
    for conv, group in groupby(after, key=lambda r: r[0]):
        group = list(group)
        turns = {t for _, t, _, _ in group if t is not None}
        seen, faults = set(), []
        for _, _, role, text in group:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        initials = [role[:1] for _, _, role, _ in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = cheapest([r[2:] for r in group], faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in (*C._COUNTS, "audit", "repaired_sha256")) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_tables(spark, name):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{name}/conversations.parquet").collect()]
    assert got(QUERIES["op11_conversation_repair"](spark, f"/root/testdata/{name}")) == brute(rows)


def conversation(rng, conv, n):
    roles = ["system", "user", "assistant", "tool", None, ""]
    texts = ["Fine.", "Why?", "cut off", "", " \t", None, "Long enough!  ", "one. two"]
    return [
        (conv, rng.choice([None, *range(n + 2)]), rng.choices(roles, [2, 6, 6, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}{rng.choice('.!? ')}")
        for _ in range(n)
    ]


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = [r for conv in [None, *range(150)] for r in conversation(rng, conv, rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.repair_digests(df)) == brute(rows)


@pytest.mark.parametrize("least", [1, 3])
def test_blocks_change_nothing(spark, least):
    rng = random.Random(least)
    rows = [r for conv in range(25) for r in conversation(rng, conv, rng.randrange(1, 90))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.repair_digests(df, least)) == brute(rows)


def test_walk_against_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        syms = [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(rng.randrange(0, 9))]
        rows = [("suax"[s & 3], "t") for s in syms]
        faults = ["" if s < 4 else "truncated" if s < 8 else "blank" for s in syms]
        cost, audit, _ = cheapest(rows, faults)
        assert "".join(e[0] for e in C.walk(syms, 0, C.relaxed(C.END), True)[1]) == audit
        assert C.applied(C.matrix(syms), C.relaxed(C.END))[0] == cost


def test_repaired_rows_are_well_formed(spark):
    rng = random.Random(8)
    rows = [r for conv in range(30) for r in conversation(rng, conv, 20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, g int")
    found = C.repaired(C.repair(df, 4)).orderBy("conv", "blk", "seq").collect()
    by_conv = {}
    for r in found:
        by_conv.setdefault(r.conv_id, []).append(r.role[0])
    assert by_conv and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by_conv.values())


def test_a_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(2)
    hot = [(5, i, ("user", "assistant")[i % 2], f"Turn {rng.randrange(3000)}.") for i in range(4000)]
    rows = hot + [r for conv in range(100, 900) for r in conversation(rng, conv, 10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert got(C.repair_digests(df)) == brute(rows)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert got(C.repair_digests(spark.createDataFrame([], schema))) == {}
    rows = [(None, None, None, None)] * 3 + [(1, None, "user", "Same."), (1, None, "user", "Same."), (2, 7, "user", "x" * 300_000)]
    assert got(C.repair_digests(spark.createDataFrame(rows, schema))) == brute(rows)
