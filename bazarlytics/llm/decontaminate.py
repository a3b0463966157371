"""Benchmark passages in documents, found by latent semantic retrieval.

Benchmark items are cut into passages, weighted by TF-IDF with document frequencies of the
whole corpus, and a randomised SVD, whose products are Spark jobs over the passages, gives
the latent space. Overlapping windows run over every document; a window whose cosine with a
passage is large enough makes the item a candidate there. A candidate counts if the longest
common subsequence of words covers most of the item, or a good part of it and the item's
answer stands in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import batch, numbered, slices, store, utf8

STEP = 16  # words of a block; a window is two blocks
RARE = 4  # rare words of an item that must stand around a window before it is compared
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, other ASCII signs than letters and digits part words."""
    return text.translate(_SPACED).split()


@dataclass
class Item:
    """A benchmark item: its words, and the words of its answer."""

    item_id: int
    words: list[bytes]
    answer: list[bytes]


def items_of(rows: list[tuple]) -> list[Item]:
    """From (item_id, text, answer). Without an answer the last five words stand for it."""
    out = []
    for item_id, text, answer in rows:
        words = words_of((text or "").encode())
        told = words_of((answer or "").encode())
        if words:
            out.append(Item(item_id, words, told or words[-5:]))
    return out


def passages_of(words: list) -> list[list]:
    """Runs of two blocks of words that start at every block."""
    starts = range(0, max(1, len(words) - STEP), STEP)
    return [words[s : s + 2 * STEP] for s in starts]


def common_length(masks: dict[int, int], n: int, words: np.ndarray) -> int:
    """Length of the longest common subsequence of an item, given as the places of each of its
    words, and a run of words."""
    full = (1 << n) - 1
    row = full
    for w in words.tolist():
        at = masks.get(w)
        if at:
            hit = row & at
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each word occurs, and the number of documents."""
    width = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = vocabulary.keys(), np.zeros(width, np.int64)
        for b in batches:
            for t in b.column(0):
                found = known & set(words_of(t.as_py()))
                counts[[vocabulary[w] for w in found]] += 1
            counts[0] += b.num_rows
        at = np.flatnonzero(counts)
        yield batch(word=at, n=counts[at])

    rows = docs.select(utf8(F.col("text"))).mapInArrow(run, "word long, n long")
    total = np.zeros(width, np.int64)
    for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per benchmark word
        total[r["word"]] = r["n"]
    return total[1:], int(total[0])


def randomised_svd(passages: DataFrame, width: int, rank: int, rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Right singular vectors (width x rank or fewer) of the sparse rows (cols, vals).

    Each product of the matrix and its transpose with a thin one is a job: tasks multiply and
    add up their rows, and what comes from different tasks is added for every 500 words.
    """
    thin = min(rank + 10, width)
    basis = np.random.default_rng(seed).normal(size=(width, thin))

    def product(given: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((width, thin))
            for b in batches:
                for cols, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out[cols] += np.outer(vals, np.array(vals) @ given[cols])
            for low in range(0, width, 500):
                if out[low : low + 500].any():
                    yield batch(first=[low], part=[out[low : low + 500].tobytes()])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p) for p in frame["part"])
            return pd.DataFrame({"first": frame["first"].iloc[:1], "part": [total.tobytes()]})

        parts = passages.select("cols", "vals").mapInArrow(run, "first long, part binary")
        total = np.zeros((width, thin))
        for r in parts.groupBy("first").applyInPandas(add, "first long, part binary").collect():
            rows = np.frombuffer(r["part"]).reshape(-1, thin)
            total[r["first"] : r["first"] + len(rows)] = rows
        return total

    for _ in range(rounds - 1):
        basis, _ = np.linalg.qr(product(basis))
    small = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[: min(rank, thin)]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-12)]
    return basis @ vectors[:, keep]


@dataclass
class Index:
    """What a task needs to search: word numbers, latent vectors of the words (0 is unknown
    words), unit passages and their items."""

    vocabulary: dict[bytes, int]
    latent: np.ndarray
    passages: np.ndarray
    owner: np.ndarray
    items: list[Item]
    rare: Rare


@dataclass
class Rare:
    """For every word number the items that have it among their rarest words, and what each
    item asks of a run of words: at least `least` of those words within `reach` blocks."""

    start: np.ndarray
    items: np.ndarray
    least: np.ndarray
    reach: np.ndarray

    def near(self, flat: np.ndarray, block: np.ndarray, total: int) -> np.ndarray:
        """Windows by items: whether so many rare words stand in the run that is compared.

        The run may reach over the end of a document, which only lets more windows through.
        """
        times = np.diff(self.start)
        at = np.flatnonzero(times[flat])
        each = times[flat[at]]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - self.start[flat[at]], each)
        n = len(self.least)
        counts = np.bincount(np.repeat(block[at], each) * n + self.items[place], minlength=total * n)
        upto = np.zeros((total + 1, n), np.int32)
        np.cumsum(counts.reshape(total, n), axis=0, out=upto[1:])
        out = np.zeros((total, n), bool)
        where = np.arange(total)
        for reach in np.unique(self.reach):
            mine = np.flatnonzero(self.reach == reach)
            part = upto[:, mine]
            high, low = np.minimum(where + 2 + reach, total), np.maximum(where - reach, 0)
            out[:, mine] = part[high] - part[low] >= self.least[mine]
        return out


def rare_words(items: list[Item], vocabulary: dict[bytes, int], frequency: np.ndarray, share: float) -> Rare:
    """A common subsequence of at least that share of an item leaves out at most n - least of
    its n words, so of any n - least + RARE words it holds RARE. The rarest are taken."""
    owners: list[list[int]] = [[] for _ in range(len(vocabulary) + 1)]
    least = []
    for k, item in enumerate(items):
        numbers = np.array([vocabulary[w] for w in item.words])
        n = len(numbers)
        kept = max(0, int(np.ceil(share * n - 1e-9)))
        least.append(min(RARE, kept))
        rarest = np.argsort(frequency[numbers - 1], kind="stable")[: n - kept + least[-1]]
        for number in set(numbers[rarest].tolist()):
            owners[number].append(k)
    start = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
    flat = np.array([k for o in owners for k in o], np.int64)
    reach = np.array([-(-len(item.words) // STEP) for item in items], np.int64)
    return Rare(start, flat, np.array(least), reach)


def build(docs: DataFrame, benchmark: DataFrame, items: list[Item], rank: int, share: float = 0.6) -> Index:
    own = {w for item in items for w in item.words}
    told = {w for item in items for w in item.answer} - own  # numbered, but without a latent vector
    vocabulary = {w: i for i, w in enumerate([*sorted(own), *sorted(told)], 1)}
    frequency, n = document_frequencies(docs, vocabulary)
    weight = np.log((1 + n) / (1 + frequency)) + 0.05
    weight = np.concatenate([[0.0], weight])
    ids = {item.item_id for item in items}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, vals = [], []
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in passages_of(words_of(text or b"")) if item_id in ids else []:
                    found, counts = np.unique([vocabulary[w] for w in part if w in vocabulary], return_counts=True)
                    if len(found):
                        cols.append((found - 1).astype(np.int64))
                        vals.append(counts * weight[found.astype(int)])
            yield batch(cols=pa.array(cols, pa.list_(pa.int64())), vals=pa.array(vals, pa.list_(pa.float64())))

    source = benchmark.select("item_id", F.col("text").cast("binary"))
    table = store(source.mapInArrow(rows, "cols array<long>, vals array<double>"), "benchmark-passages")
    space = randomised_svd(table, len(own), rank)
    latent = np.zeros((len(vocabulary) + 1, space.shape[1]), np.float32)
    latent[1 : len(own) + 1] = space * weight[1 : len(own) + 1, None]
    vectors, owner = [], []
    for k, item in enumerate(items):
        for part in passages_of(item.words):
            vector = latent[[vocabulary[w] for w in part]].sum(0)
            vectors.append(vector / max(np.linalg.norm(vector), 1e-9))
            owner.append(k)
    rare = rare_words(items, vocabulary, frequency, share)
    return Index(vocabulary, latent, np.array(vectors, np.float32), np.array(owner), items, rare)


def search(index: Index, texts: list[bytes], cosine: float, copied: float, paraphrased: float) -> list[tuple]:
    """(row, item, cosine, lcs, answer) of every item found in a text."""
    get, n_items = index.vocabulary.get, len(index.items)
    split = [words_of(t) for t in texts]
    docs = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in split]
    lengths = np.array([len(d) for d in docs], np.int64)
    blocks = -(-lengths // STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    if not total:
        return []
    flat = np.concatenate(docs)
    offsets = np.cumsum(lengths) - lengths
    block = np.repeat(first[:-1], lengths) + (np.arange(len(flat)) - np.repeat(offsets, lengths)) // STEP
    follows = np.ones(total, bool)
    follows[first[1:][blocks > 0] - 1] = False  # a document's last block stands alone
    near = index.rare.near(flat, block, total)
    wanted = near.any(1)
    summed = wanted.copy()
    summed[1:] |= wanted[:-1] & follows[:-1]
    known = np.flatnonzero((flat > 0) & summed[block])
    sums = np.zeros((total, index.latent.shape[1]), np.float32)
    if len(known):
        owners = block[known]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1])
        sums[owners[starts]] = np.add.reduceat(index.latent[flat[known]], starts, axis=0)
    likely = np.flatnonzero(wanted)
    masks: dict[int, dict[int, int]] = {}
    best: dict[tuple[int, int], tuple] = {}
    for at in range(0, len(likely), 2048):
        rows = likely[at : at + 2048]
        window = sums[rows]
        has = np.flatnonzero(follows[rows])
        window[has] += sums[rows[has] + 1]
        inside = np.sqrt((window * window).sum(1))  # the part of a window that lies in the space
        cos = (window @ index.passages.T) / np.maximum(inside[:, None], 1e-9)
        over = (cos >= cosine) & (inside[:, None] > 0) & near[np.ix_(rows, index.owner)]
        for p, q in zip(*(x.tolist() for x in np.nonzero(over))):
            item, where = int(index.owner[q]), int(rows[p])
            doc = int(np.searchsorted(first, where, "right")) - 1
            told = index.items[item]
            n = len(told.words)
            if item not in masks:
                masks[item] = {}
                for i, w in enumerate(told.words):
                    number = index.vocabulary[w]
                    masks[item][number] = masks[item].get(number, 0) | 1 << i
            start = (where - int(first[doc])) * STEP
            run = docs[doc][max(0, start - n) : start + 2 * STEP + n]
            share = common_length(masks[item], n, run) / n
            if share < min(copied, paraphrased):
                continue
            answer = [index.vocabulary.get(w, -1) for w in told.answer]
            spots = np.flatnonzero(run == answer[0])
            there = any(run[s : s + len(answer)].tolist() == answer for s in spots.tolist())
            if share >= copied or there:
                key, found = (doc, item), (share, float(cos[p, q]), there)
                best[key] = max(best.get(key, found), found)
    return [(doc, item, c, share, there) for (doc, item), (share, c, there) in sorted(best.items())] if n_items else []


def find(
    docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None, rank: int = 384, cosine: float = 0.5,
    copied: float = 0.8, paraphrased: float = 0.6, item_block: int = 200,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words) and answer_found of every find.

    A window is compared where the run around it holds enough of an item's rarest words for the
    shares below to be possible, which loses no find at any number of documents; a passage is
    a candidate from the cosine on. An item counts as copied or
    paraphrased from those shares of its words in order; the latter needs its answer too.
    Items go through in blocks of `item_block`, each against all documents, which bounds what
    the driver and the tasks hold; the rank nearly holds a block's passages whole. Texts are searched whole. Null and empty texts hold
    nothing, items without words are found nowhere. Repeated documents each have their rows.
    An empty table on either side gives no rows. Other columns are ignored.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, cosine double, lcs double, answer_found boolean"
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    wanted = wanted.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    source = docs.select("doc_id", utf8(F.col("text")))
    found = None
    for part in _blocks(wanted, item_block):
        items = items_of([tuple(r) for r in part.collect()])  # at most item_block rows
        if not items:
            continue
        index = build(docs, part, items, rank, min(copied, paraphrased))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t.as_py() for t in b.column(1)]
                for low, high in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 300_000):
                    rows = search(index, texts[low:high], cosine, copied, paraphrased)
                    if rows:
                        at, item, cos, share, there = zip(*rows)
                        yield batch(
                            doc_id=b.column(0).slice(low).take(pa.array(at)),
                            item_id=[index.items[i].item_id for i in item],
                            cosine=list(cos), lcs=list(share), answer_found=list(there),
                        )

        more = source.mapInArrow(run, schema)
        found = more if found is None else found.union(more)
    return spark.createDataFrame([], schema) if found is None else found


def _blocks(items: DataFrame, size: int) -> Iterator[DataFrame]:
    """The items by id in blocks of at most that many."""
    last = None
    while True:
        rest = items if last is None else items.where(F.col("item_id") > last)
        ids = [r[0] for r in rest.select("item_id").distinct().orderBy("item_id").limit(size).collect()]
        if not ids:
            return
        last = ids[-1]
        yield rest.where(F.col("item_id") <= last)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item is found, all columns as they were. Rows are
    told apart by their place, so that a find removes its own row only, whatever its id."""
    rows, row = numbered(docs)
    found = find(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, **options)
    hit = store(found.select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return rows.join(hit, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
