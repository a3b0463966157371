"""Phrase collocations, mined by Toivonen's method with exact counts.

A sample of the documents proposes the phrases that are frequent there at a lowered bound.
One pass over all documents then counts every phrase whose beginning and ending without a
word are proposed: the proposals by their words, and their negative border by hashes, whose
sums bound the counts from above. What the border may hold of frequent phrases is a failure:
further passes count it and all that it opens up exactly, until no failure is left.

The proposals travel as a Bloom filter of bounded size. What it lets through by mistake is
counted as well, so that its size decides the work and never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.llm.common import batch, store, utf8

#: Characters that end a piece; a tab parts words like a space.
ENDS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE = 4_000_000  # bytes of text that a task looks at together
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
PROBES = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def portions(texts: list[bytes], most: int = SLICE) -> Iterator[list[tuple[int, bytes]]]:
    """(row, mapped text) in lists of at most about that many bytes; a longer text is cut where
    a piece ends, so that no phrase is lost."""
    held, size = [], 0
    for row, text in enumerate(texts):
        text, at = text.translate(_MAP), 0
        while at < len(text):
            to = len(text)
            if to - at > most:
                cut = text.rfind(b"\n", at + 1, at + most)
                cut = cut if cut > 0 else text.find(b"\n", at + 1)
                to = cut if cut > 0 else to
            if size and size + to - at > most:
                yield held
                held, size = [], 0
            held.append((row, text[at:to]))
            size, at = size + to - at, to
    if held:
        yield held


class Words:
    """The words of some texts: `word` has their places in `known`, `piece` tells pieces apart,
    `of` is the language and `code` word and language as one number."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, names: list[str]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = data == 10
        inside = ~(ends | (data == 32))
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, stops = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
        found = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
        self.known, self.word = found.dictionary, found.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(ends, dtype=np.int32)[starts]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        self.of, self.names = langs[self.text], names
        self.code = self.of * len(self.known) + self.word
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 5) for x in names], np.uint64)
        hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in self.known.to_pylist()], np.uint64)
        self.hash = hashes[self.word] if len(hashes) else np.zeros(0, np.uint64)
        self.seeds = seeds[self.of] if len(seeds) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.word)

    def hashes(self, size: int, before: np.ndarray | None) -> np.ndarray:
        """A hash of the phrase of that many words at every place, from those of one word less."""
        mixed = self.seeds if before is None else before[: len(self) - size + 1]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0] + self.hash[size - 1 :]
        return (mixed ^ (mixed >> np.uint64(32))) * _ODD[1]

    def within(self, size: int) -> np.ndarray:
        """Where a phrase of that many words stays in its piece."""
        n = max(0, len(self) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :] if n else np.zeros(0, bool)

    def classes(self, places: np.ndarray, size: int, before: np.ndarray | None) -> tuple[np.ndarray, int]:
        """Numbers that tell the phrases at some places apart, and how many they are. `before`
        has such numbers of the phrases of one word less at all places."""
        width = max(1, len(self.known))
        if size == 1:
            key = self.code[places]
        elif before is not None:
            key = before[places] * width + self.word[places + size - 1]
        else:
            key = self.classes(places, size - 1, None)[0] * width + self.word[places + size - 1]
        found = pa.array(key).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), len(found.dictionary)

    def phrases(self, places: np.ndarray, size: int) -> pa.Array:
        parts = [self.known.take(pa.array(self.word[places + j])) for j in range(size)]
        return pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mask, stride = np.uint64(bits - 1), (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (hashes + np.uint64(i) * stride) & mask


def member(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in probes(hashes, len(bitmap) * 64):
        out &= (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


@dataclass(frozen=True)
class Pass:
    """What a pass over texts counts: phrases of low to high words whose beginning and ending
    without a word are open.

    Those that the filter `now` has, or that have more than `trusted` words, are open themselves
    and counted by their words; the others, the border, by a hash of 64 bits. A sum over a hash
    is never below a phrase's own count, so a border phrase below the bound is done with. After
    a pass with the filter `old` only what that pass did not count is counted; with `leap`, new
    phrases are all open.
    """

    low: int
    high: int
    now: np.ndarray | None = None
    trusted: int = 99
    old: np.ndarray | None = None
    leap: bool = False

    def counts(self, words: Words) -> Iterator[tuple[int, pa.Array | None, pa.Array | None, np.ndarray | None, np.ndarray]]:
        """(size, languages, phrases, None, counts), or (size, None, None, hashes, counts)."""
        hashed, codes, opened, was_open = None, None, None, None
        for size in range(1, self.high + 1):
            n = len(words) - size + 1
            if n <= 0:
                return
            fits = words.within(size)
            seen = fits if self.old is not None else np.zeros(n, bool)
            if opened is not None:
                fits = fits & opened[:n] & opened[1 : n + 1]
                seen = seen & was_open[:n] & was_open[1 : n + 1]
            if self.now is not None:
                hashed = words.hashes(size, hashed)
            inside = fits if self.now is None or size > self.trusted else fits & member(self.now, hashed)
            was_open = seen & member(self.old, hashed) if self.old is not None else seen
            fresh = fits & ~seen
            exact, border = inside & ~was_open, fresh & ~inside
            opened = inside
            if self.leap:
                exact, border, opened = exact | border, np.zeros(n, bool), inside | fresh
            places = np.flatnonzero(exact)
            if len(places) and (self.old is None or size >= self.low):
                found, m = words.classes(places, size, codes if self.old is None else None)
                if self.old is None:
                    codes = np.zeros(n, np.int64)
                    codes[places] = found
                if size >= self.low:
                    first = np.zeros(m, np.int64)
                    first[found[::-1]] = places[::-1]
                    lang = pa.array(words.names).take(pa.array(words.of[first]))
                    yield size, lang, words.phrases(first, size), None, np.bincount(found, minlength=m)
            if size >= self.low and border.any():
                found = pa.array(hashed[border].view(np.int64)).dictionary_encode()
                yield size, None, None, found.dictionary.to_numpy(), np.bincount(found.indices.to_numpy())


def count_phrases(docs: DataFrame, what: Pass) -> DataFrame:
    """(lang, size, phrase, hash, n) over rows (lang, bytes): see Pass; phrase is null for the border
    and hash zero for the rest. A first pass from words on also has a row of size 0 per language
    with the number of its words. Tasks add up first, so that the rows of a frequent phrase are
    as many as there are portions of text, not as its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, langs, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = sorted(set(langs))
            numbers = np.array([names.index(x) for x in langs], np.int64)
            for part in portions(held):
                words = Words([t for _, t in part], numbers[[row for row, _ in part]], names)
                if what.low == 1 and what.old is None and len(words):
                    totals = np.bincount(words.of, minlength=len(names)).astype(np.int64)
                    yield _rows(0, pa.array(names), pa.array([b""] * len(names), pa.binary()), None, totals)
                for k, lang, phrase, hashes, n in what.counts(words):
                    for at in range(0, len(n), 50_000):
                        yield _rows(k, *(x if x is None else x[at : at + 50_000] for x in (lang, phrase, hashes, n)))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if size and size + len(text) > SLICE:
                    yield from flush()
                    held, langs, size = [], [], 0
                held.append(text)
                langs.append(lang)
                size += len(text)
        if held:
            yield from flush()

    rows = docs.mapInArrow(run, "lang string, size int, phrase binary, hash long, n long")
    return rows.groupBy("lang", "size", "phrase", "hash").agg(F.sum("n").alias("n"))


def _rows(size: int, lang, phrase, hashes, n: np.ndarray) -> pa.RecordBatch:
    k = len(n)
    return batch(
        lang=pa.nulls(k, pa.string()) if lang is None else lang, size=np.full(k, size, np.int32),
        phrase=pa.nulls(k, pa.binary()) if phrase is None else phrase,
        hash=np.zeros(k, np.int64) if hashes is None else hashes, n=n.astype(np.int64),
    )


def filter_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter with that many bits of (lang, size, phrase); the driver gets its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sizes = b.column(0).to_pylist(), b.column(1).to_numpy()
            names = sorted(set(langs))
            words = Words(b.column(2).to_pylist(), np.array([names.index(x) for x in langs], np.int64), names)
            starts, hashed, found = np.searchsorted(words.text, np.arange(len(sizes))), None, []
            for size in range(1, int(sizes.max(initial=0)) + 1):
                hashed = words.hashes(size, hashed)
                found.append(hashed[starts[sizes == size]])
            yield _slots(np.concatenate(found) if found else np.zeros(0, np.uint64), bits)

    return _bitmap(phrases.select("lang", "size", "phrase").mapInArrow(run, "slot long, value long"), bits)


def filter_of_hashes(hashes: DataFrame, bits: int) -> np.ndarray:
    """The same of a column of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _slots(b.column(0).to_numpy().view(np.uint64), bits)

    return _bitmap(hashes.mapInArrow(run, "slot long, value long"), bits)


def _slots(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """The filter's words that the hashes set bits in."""
    at = np.unique(np.concatenate([*probes(hashes, bits)]))
    slots, first = np.unique(at >> np.uint64(6), return_index=True)
    values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
    return batch(slot=slots.astype(np.int64), value=values.view(np.int64))


def _bitmap(parts: DataFrame, bits: int) -> np.ndarray:
    table = parts.groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("slot").to_numpy()] = table.column("value").to_numpy().view(np.uint64)
    return out


def propose(docs: DataFrame, least: int, longest: int, share: float) -> DataFrame:
    """(lang, size, phrase) of the phrases frequent in a share of the documents, at a bound
    lowered by one and a half standard deviations: words and pairs first, then what they open."""
    scale = 1_000_003
    sample = store(docs.where(F.pmod(F.xxhash64("salt", "bytes"), F.lit(scale)) < int(share * scale)), "phrase-sample")
    expected = least * share
    bound = F.col("n") >= max(2, math.floor(expected - 1.5 * math.sqrt(expected)))
    short = store(count_phrases(sample.select("lang", "bytes"), Pass(1, min(2, longest))).where(bound & (F.col("size") > 0)), "short-proposals")
    if longest <= 2:
        return short
    bitmap = filter_of(short, filter_bits(short.count()))
    long = count_phrases(sample.select("lang", "bytes"), Pass(3, longest, bitmap, trusted=2)).where(bound)
    return store(short.union(long).select("lang", "size", "phrase"), "proposals")


def filter_bits(n: int) -> int:
    """Sixteen bits a phrase, as a power of two between fixed bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: float = 0.1, leap_share: float = 0.05) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of up to `longest` words with at least `least`
    occurrences, and a row of size 0 per language with its number of words.

    `share` is the share of documents that propose. When border failures are few beside the
    proposals (`leap_share`), one pass counts all that they open; else each pass has a border
    of its own. Neither changes the result, nor do hashes that meet. A null text counts as empty, a null language as
    `und`; repeated rows count each time. No documents give no rows. Other columns are ignored.
    """
    salt = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit("")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8(F.col("text")).alias("bytes"), salt.alias("salt"))
    proposed = propose(rows, least, longest, share)
    known, rows = proposed.count(), rows.select("lang", "bytes")
    now = filter_of(proposed, filter_bits(known))
    often = F.col("n") >= least
    whole = count_phrases(rows, Pass(1, longest, now)).where(often | (F.col("size") == 0))
    counted = store(whole, "counted-phrases")
    found = counted.where("phrase IS NOT NULL")
    failures = counted.where("phrase IS NULL").select("hash")
    while n := failures.count():
        old, now = now, now | filter_of_hashes(failures, len(now) * 64)
        leap = n <= leap_share * known
        counted = store(count_phrases(rows, Pass(1, longest, now, old=old, leap=leap)).where(often), "opened-phrases")
        found, known = found.union(counted.where("phrase IS NOT NULL")), known + n
        failures = counted.where("phrase IS NULL").select("hash")  # none after a leap, which leaves no border
    return found.select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "n")


def _words(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of two words and more: the cut with
    the lowest score floor(1000 a n / (l r)), of several the one after the fewest words."""
    totals = store(found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
    counts = found.where("size > 0").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = counts.where("size > 1").join(totals, "lang")
    cuts = words.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns(
        {"left": _words(F.col("phrase"), F.lit(1), F.col("k")), "right": _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k"))}
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr("(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    least = joined.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, within: int = 100, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases.

    A phrase that stands in a longer frequent one with at least `within` percent of its
    occurrences is left out. Of longer phrases only those one word longer need a look, since a
    phrase occurs no more often than its parts. See frequent_phrases() for odd rows.
    """
    found = store(frequent_phrases(docs, least, longest, **options), "mined-phrases")
    longer = found.where("size > 2").select(
        "lang", F.col("n").alias("f"),
        F.explode(F.array(_words(F.col("phrase"), F.lit(1), F.col("size") - 1), _words(F.col("phrase"), F.lit(2), F.col("size") - 1))).alias("phrase"),
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored(found).join(most, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < within * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: parts of it are ranked first, and only their heads together
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    heads = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
