"""Even shards by balanced label propagation.

Every document starts in a shard given by a hash. In each round a document looks at the
shards of the documents it is linked with and asks to move to the most frequent one. Moves
between two shards are granted as far as the numbers of documents allow, so that no shard
outgrows its quota. At the end the few documents by which shards still differ from their
quotas are moved, those without links first. What the driver sees are counts per pair of
shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import store
from bazarlytics.operators.ordering import number_rows


def equal_links(rows: DataFrame, key: list[str], largest: int) -> DataFrame:
    """(row_id, hub) for rows with equal keys, nulls being equal to each other.

    A hub stands for one key. The rows of a key that has more than `largest` are dealt over
    several hubs, none larger than about that, since a shard could not hold more.
    """
    groups = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").toDF(*(f"_{k}" for k in key), "_n")
    same = [rows[k].eqNullSafe(groups[f"_{k}"]) for k in key]
    part = F.pmod(F.xxhash64("row_id", F.lit(3)), F.ceil(F.col("_n") / max(1, largest)))
    return rows.join(groups, same).select("row_id", F.xxhash64(*key, part).alias("hub"))


def _granted(asked: dict[tuple[int, int], int], sizes: dict[int, int], quota: dict[int, int]) -> dict[tuple[int, int], float]:
    """The share of the asked moves that is granted for every pair of shards: swaps in full, and
    more into a shard as far as its quota has room."""
    share = {}
    room = {s: quota[s] - sizes.get(s, 0) for s in quota}
    for (a, b), n in sorted(asked.items()):
        swaps = min(n, asked.get((b, a), 0))
        extra = max(0, min(n - swaps, room[b]))
        room[b] -= extra
        room[a] += extra
        share[a, b] = (swaps + extra) / n
    return share


def propagate(nodes: DataFrame, links: DataFrame, shards: int, rounds: int, total: int, slack: float = 0.25) -> DataFrame:
    """(row_id, label) for all nodes after the rounds; links are (row_id, hub).

    A round counts the labels around every hub, which combines before the shuffle, and joins
    each hub's most frequent one to its documents; a hub with very many documents is a skewed
    join key, which Spark splits. All documents of a hub ask for the same shard, so two never
    just change places. Granted shares are drawn by a hash. While labels move, a shard may hold that much more than its quota; even_shards() evens it out.
    """
    quota = {s: math.ceil(total / shards * (1 + slack)) + 1 for s in range(shards)}
    now = store(
        nodes.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int").alias("label")), "labels-0"
    )
    for turn in range(rounds):
        placed = links.join(now, "row_id")
        seen = placed.groupBy("hub", "label").agg(F.count("*").alias("n"))
        # of equals, the one that a hash of hub and label puts first, so that ties spread
        best = seen.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "label").alias("h"), "label")).alias("b"))
        wish = placed.join(best.select("hub", F.col("b.label").alias("to")), "hub").where("label <> to")
        wish = store(wish.select("row_id", "label", "to"), f"wishes-{turn}")
        asked = {(r["label"], r["to"]): r["n"] for r in wish.groupBy("label", "to").agg(F.count("*").alias("n")).collect()}
        if not asked:
            break
        sizes = {r["label"]: r["n"] for r in now.groupBy("label").agg(F.count("*").alias("n")).collect()}
        grants = F.create_map(*[x for (a, b), s in _granted(asked, sizes, quota).items() for x in (F.lit(a * shards + b), F.lit(s))])
        draw = F.pmod(F.xxhash64("row_id", F.lit(turn + 1000)), F.lit(1_000_003)) / 1_000_003
        moves = wish.where(draw < grants[F.col("label") * shards + F.col("to")]).select("row_id", "to")
        now = store(now.join(moves, "row_id", "left").select("row_id", F.coalesce("to", "label").alias("label")), f"labels-{turn + 1}")
    return now


def even_shards(docs: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is `rows`: the numbers of documents per shard differ by one at most. Slots are
    gapless from 0 in each shard. A null text has size 1 and the checksum of an empty one.
    Repeated rows and null ids are documents of their own. Fewer documents than shards leave
    shards empty; an empty table gives no rows. Other columns are ignored.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + 1
    numbered = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    slim = numbered.select("row_id", "doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("text"))
    slim = store(slim, "documents-to-shard")
    total = slim.count()
    links = store(equal_links(slim, ["text", "size", "text_crc32"], max(1, total // (2 * shards))), "equal-texts")
    labels = propagate(slim.select("row_id"), links, shards, rounds, total)
    placed = slim.join(labels, "row_id").join(links.withColumn("_linked", F.lit(1)), "row_id", "left")
    placed = placed.select("row_id", "doc_id", "size", "text_crc32", "label", "hub", F.coalesce("_linked", F.lit(0)).alias("_linked"))
    # documents of a hub beside each other, those without links last
    ranked = number_rows(placed, ["label", F.desc("_linked"), "hub", "row_id"], "_n").withColumn("_n", F.col("_n") - 1)
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first, over, under, moved, free = [0], [], [], 0, 0
    for s in range(shards):
        have, quota = counts.get(s, 0), total // shards + (s < total % shards)
        first.append(first[-1] + have)
        over.append((quota, moved))  # places from the quota on are numbered from `moved` on
        moved += max(0, have - quota)
        if have < quota:
            under.append((free, free + quota - have, s, have))
            free += quota - have
    lists = [F.lit(first[:-1]), F.lit([q for q, _ in over]), F.lit([m for _, m in over])]
    begin, quota, before = (F.get(x, F.col("label")) for x in lists)
    place = F.col("_n") - begin
    spare = F.when(place >= quota, before + place - quota)
    shard, slot = F.col("label"), place
    for low, high, s, have in under:
        here = (spare >= low) & (spare < high)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, spare - low + have).otherwise(slot)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
