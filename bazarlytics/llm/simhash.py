"""SimHash near-duplicates by anchor-point covering.

A fingerprint is 64 bits wide. It is cut into three segments that share the threshold, so
that two fingerprints within it agree on some segment up to that segment's part. On each
segment a covering code gives the anchors: perfect Golay or Hamming codes, with plain bits
beside them where the segment is wider. A fingerprint lives at the anchor it decodes to,
which lies within the covering radius, and visits every other anchor, within the radius
plus the segment's threshold, at which a partner can live. Each anchor's cell is compared
by itself on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.blocks import OWN, PARTNER, deal, grouped, whole_blocks
from bazarlytics.llm.common import batch, numbered, store, utf8
from bazarlytics.llm.graph import connected_components, forest

#: Check polynomials of the binary Golay code and of two Hamming codes.
GOLAY, HAMMING_15, HAMMING_7 = (23, 0b101011100011), (15, 0b10011), (7, 0b1011)

#: Segments as lists of codes; a bare number is that many plain bits. The wide layout makes
#: more and smaller cells for more copies of a fingerprint, and serves larger inputs.
LAYOUTS = {
    "golay": ([GOLAY], [GOLAY], [18]),
    "wide": ([HAMMING_15, 6], [HAMMING_15, 6], [22]),
}
WIDE_FROM = 2_000_000
BLOCK = 1024


def fingerprint(text: bytes, size: int = 4) -> int:
    """The 64-bit SimHash of lower-cased bytes, from all shingles with repeats; 0 if no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return int.from_bytes(xxhash.xxh64_digest(joined, 42), "big")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 32_768):
        span = slice(at, at + 32_768)
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[span], stops[span])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1)
            fps = [fingerprint(t.as_py(), size) for t in texts]
            yield batch(id=b.column(0), fp=np.array(fps, np.uint64).view(np.int64))

    rows = docs.select(F.col(id_col), utf8(F.col(text_col)))
    return rows.mapInArrow(run, f"id {id_type}, fp bigint").select(F.col("id").alias(id_col), "fp")


@dataclass(frozen=True)
class Code:
    """One block of a covering code: `width` bits, decoded by the remainder modulo `check`."""

    width: int
    check: int

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        degree = self.check.bit_length() - 1
        unit = []
        for i in range(self.width):
            r = 1 << i
            while r.bit_length() > degree:
                r ^= self.check << (r.bit_length() - degree - 1)
            unit.append(r)
        by_byte = []
        for low in range(0, self.width, 8):
            values = np.zeros(256, np.int64)
            for bit, r in enumerate(unit[low : low + 8]):
                values[(np.arange(256) >> bit) & 1 == 1] ^= r
            by_byte.append(values)
        leader = np.full(1 << degree, -1, np.int64)
        weight = 0
        while (leader < 0).any():  # the lightest error of every remainder
            for bits in combinations(range(self.width), weight):
                r = 0
                for i in bits:
                    r ^= unit[i]
                if leader[r] < 0:
                    leader[r] = sum(1 << i for i in bits)
            weight += 1
        return by_byte, leader


class Segment:
    """Some bits of the fingerprint, their covering code, and their part of the threshold."""

    def __init__(self, shift: int, parts, threshold: int):
        self.shift, self.threshold, self.parts, low = shift, threshold, [], 0
        for part in parts:
            if isinstance(part, int):
                low += part
            else:
                code = Code(*part)
                self.parts.append((low, code.width, *code.tables()))
                low += code.width
        self.width = low
        self.errors = np.array(
            [sum(1 << i for i in bits) for w in range(threshold + 1) for bits in combinations(range(low), w)], np.int64
        )

    def anchor(self, values: np.ndarray) -> np.ndarray:
        """The codeword nearest to each value."""
        out = values.copy()
        for low, width, by_byte, leader in self.parts:
            own = (values >> low) & ((1 << width) - 1)
            rest = np.zeros_like(own)
            for i, table in enumerate(by_byte):
                rest ^= table[(own >> (8 * i)) & 255]
            out ^= leader[rest] << low
        return out

    def bits(self, fps: np.ndarray) -> np.ndarray:
        return ((fps.view(np.uint64) >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)).astype(np.int64)


def segments(threshold: int, layout: str) -> list[Segment]:
    """Three segments whose thresholds plus one add up to the whole threshold plus one."""
    shares = [(threshold + 1) // 3 + (i < (threshold + 1) % 3) - 1 for i in range(3)]
    out, shift = [], 0
    for parts, share in zip(LAYOUTS[layout], shares):
        width = sum(p if isinstance(p, int) else p[0] for p in parts)
        if share >= 0:
            out.append(Segment(shift, parts, share))
        shift += width
    return out


def cells(distinct: DataFrame, threshold: int, layout: str) -> DataFrame:
    """(cell, role, fp): a home row per segment and a visit to each anchor before its own
    at which a partner can live. Of two partners, the one with the later anchor visits."""

    def run(batches):
        cuts = segments(threshold, layout)
        for b in batches:
            fps = b.column(0).to_numpy()
            for number, cut in enumerate(cuts):
                values = cut.bits(fps)
                own, base = cut.anchor(values), np.int64(number) << 40
                yield batch(cell=own | base, role=np.zeros(len(own), np.int32), fp=fps)
                if cut.threshold:
                    reach = np.sort(cut.anchor(values[:, None] ^ cut.errors[None, :]), axis=1)
                    fresh = np.ones(reach.shape, bool)
                    fresh[:, 1:] = reach[:, 1:] != reach[:, :-1]
                    row, col = np.nonzero(fresh & (reach < own[:, None]))
                    yield batch(cell=reach[row, col] | base, role=np.ones(len(row), np.int32), fp=fps[row])

    return distinct.select("fp").mapInArrow(run, "cell bigint, role int, fp bigint")


SHORT = 48


def _compare(frames: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    for frame, starts in whole_blocks(frames):
        ids, side = frame["fp"].to_numpy(), frame["side"].to_numpy()
        fp = ids.view(np.uint64)
        sizes = np.diff(starts)
        left, right = [], []
        block_of = np.repeat(np.arange(len(sizes)), sizes)
        short = np.repeat(sizes <= SHORT, sizes)
        for step in range(1, min(SHORT, int(sizes.max()))):  # all short blocks at once
            first = np.flatnonzero(short[:-step] & (block_of[:-step] == block_of[step:]))
            if not len(first):
                break
            second = first + step  # sides are sorted: own rows come before partners
            meets = (side[first] != PARTNER) & ((side[second] == PARTNER) | (side[first] == OWN))
            first, second = first[meets], second[meets]
            near = np.bitwise_count(fp[first] ^ fp[second]) <= threshold
            left.append(ids[first[near]])
            right.append(ids[second[near]])
        for k in np.flatnonzero(sizes > SHORT):
            rows = slice(starts[k], starts[k + 1])
            f, s, i = fp[rows], side[rows], ids[rows]
            here = np.flatnonzero(s != PARTNER)
            for at in range(0, len(here), 512):
                mine = here[at : at + 512]
                p, q = np.nonzero(np.bitwise_count(f[mine][:, None] ^ f[None, :]) <= threshold)
                p = mine[p]
                meets = (s[q] == PARTNER) | ((s[p] == OWN) & (p < q))
                if meets.any():
                    a, b = forest(i[p[meets]], i[q[meets]])
                    left.append(a)
                    right.append(b)
        if left and sum(map(len, left)):
            a, b = forest(np.concatenate(left), np.concatenate(right))
            yield pd.DataFrame({"a": a, "b": b})


def near_groups(prints: DataFrame, threshold: int = 4, id_col: str = "doc_id", layout: str | None = None) -> DataFrame:
    """The rows (id, fp) with component_id, the smallest id reachable over fingerprints that
    differ in at most `threshold` bits.

    Equal fingerprints are one class, whatever their number. Every class takes part in the
    search under its fingerprint, which is never null; ids only name what was found; a cell above the block size is compared in blocks by several tasks, and what a
    task reports is a spanning forest of its links, not the pairs.
    """
    prints = store(prints, "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min(id_col).alias("id")), "fingerprint-classes")
    if layout is None:
        layout = "golay" if distinct.count() < WIDE_FROM else "wide"
    members = cells(distinct, threshold, layout)
    dealt = grouped(deal(members, BLOCK, "fp"))
    links = dealt.mapInPandas(lambda frames: _compare(frames, threshold), "a bigint, b bigint")
    found = connected_components(links, "a", "b")
    classes = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("root")
    )
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    return prints.join(classes.join(smallest, "root").select("fp", "component_id"), "fp")


def simhash_groups(docs: DataFrame, size: int = 4, threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    A null text counts as empty; a text without words has fingerprint zero and links like any
    other. Repeated rows stay; a null id takes part with its fingerprint and gets the
    smallest id reached. An empty table gives no rows. Other columns are ignored.
    """
    prints = fingerprints(docs, size)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(prints, threshold).select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, size: int = 4, threshold: int = 4) -> DataFrame:
    """One document of every group, all columns as they were; see first_rows()."""
    rows, row = numbered(docs)
    groups = near_groups(fingerprints(rows, size, row), threshold, row)
    return first_rows(rows, row, groups.select(row, "component_id"))


def first_rows(rows: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """Of every component of (row id, component_id) the row with the smallest doc_id.

    Only the text groups rows: different texts stay, also without an id or under one id. A
    row without an id stays if its group has none with one; equal ids are told apart by row.
    """
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").isNull().alias("bare"), "doc_id")
    ids = ids.join(groups.withColumnRenamed(row, "row"), "row")
    first = ids.groupBy("component_id").agg(F.min(F.struct("bare", "doc_id", "row")).alias("first"))
    kept = store(first.select(F.col("first.row").alias(row)), "kept-rows")
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns if c != row))
