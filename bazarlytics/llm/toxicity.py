"""Toxicity classifier with counterfactual regularisation.

A document is the set of its words and word beginnings. Features tied to the label are
picked by a likelihood-ratio test, and a sparse logistic model is fitted on a bounded
sample of labelled documents. Sentences of that sample that mention a group of people are
paired with copies that mention another group, and the fit penalises a change of score
within a pair. A mention of a group by itself then does not raise the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import batch, store, utf8

#: Words for groups of people; a swap stays within its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
_LINE = {term: line for line in IDENTITY_TERMS for term in line}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
BITS = 22
PREFIXES = (3, 4, 5, 6)


def word_features(word: str) -> list[int]:
    """The hashed features of a lower-cased word: itself and its beginnings."""
    names = ["=" + word] + [word[:n] for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(n.encode()) >> (32 - BITS) for n in names]


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def swap(word: str, turn: int) -> str:
    """Another term of the word's line, or the word itself if it names no group."""
    line = _LINE.get(word)
    return word if line is None else line[(line.index(word) + 1 + turn % (len(line) - 1)) % len(line)]


def swapped_pairs(text: str) -> Iterator[tuple[set[int], set[int]]]:
    """Features of every sentence that names a group, before and after a swap of the terms."""
    for turn, sentence in enumerate(_SENTENCE.split(text)):
        words = set(_WORD.findall(sentence))
        if not words.isdisjoint(_LINE):
            yield features(words), features({swap(w, turn) for w in words})


@dataclass
class Model:
    """Weights by feature; `bias` alone scores a text without known features."""

    bias: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[str], float]:
        weights, kept = self.weights, {}

        def active(word: str) -> tuple[int, ...]:
            if word not in kept:
                if len(kept) > 300_000:
                    kept.clear()
                kept[word] = tuple(f for f in word_features(word) if f in weights)
            return kept[word]

        def score(text: str) -> float:
            found = {f for w in set(_WORD.findall(text.lower())) for f in active(w)}
            margin = self.bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

        return score


@dataclass
class Rows:
    """Sparse rows: row and column of every entry, and the number of rows."""

    row: np.ndarray
    column: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: pa.ChunkedArray) -> Rows:
        lists = lists.combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        return cls(np.repeat(np.arange(len(lists), dtype=np.int32), lengths), lists.flatten().to_numpy(), len(lists))


def train(
    names: np.ndarray, rows: Rows, labels: np.ndarray, before: Rows, after: Rows,
    counterfactual: float = 10.0, l1: float = 1e-5, steps: int = 1500,
) -> Model:
    """Accelerated proximal gradient on mean log loss + l1 * |w| + counterfactual * mean squared
    change of the margin over the pairs. Columns are places in `names`. One label alone gives its
    own share as the score."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(bias=30.0 if share else -30.0)
    n, m, width, r, c = len(labels), max(1, before.n), len(names), rows.row, rows.column
    pr, pc = np.concatenate([before.row, after.row]), np.concatenate([before.column, after.column])
    sign = np.repeat([1.0, -1.0], [len(before.row), len(after.row)])

    def change(w):  # margins of the pairs, before less after
        return np.bincount(pr, sign * w[pc], m)

    # a step below the inverse of the curvature, found by power iteration
    v, size = np.ones(width), 1.0
    for _ in range(30):
        v = np.bincount(c, np.bincount(r, v[c], n)[r], width) / (4 * n) + 2 * counterfactual / m * np.bincount(
            pc, sign * change(v)[pr], width
        )
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 0.9 / (size + 0.25)
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    look_w, look_b, t = w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, look_w[c], n) + look_b, -30, 30)))
        error = (p - labels) / n
        slope = np.bincount(c, error[r], width) + 2 * counterfactual / m * np.bincount(pc, sign * change(look_w)[pr], width)
        new = look_w - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias, t_next = look_b - step * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w = new + (t - 1) / t_next * (new - w)
        look_b = new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new, new_bias, t_next
    return Model(float(bias), {int(f): float(x) for f, x in zip(names, w) if x})


def _placed(names: np.ndarray):
    """A task that turns lists of features into their places in `names`, for those that have one.
    Other columns stay; of two lists that come out equal the row is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, kind = [], pa.list_(pa.int32())
            for lists in b.columns:
                if not pa.types.is_list(lists.type):
                    columns.append(lists)
                    continue
                found = [np.array(x, np.int32) for x in lists.to_pylist()]
                places = [np.searchsorted(names, x) for x in found]
                known = [p[names[np.minimum(p, len(names) - 1)] == x].astype(np.int32) for p, x in zip(places, found)]
                columns.append(pa.array(known, kind))
            out = pa.RecordBatch.from_arrays(columns, b.schema.names)
            if all(c.type == kind for c in columns):
                first, second = (c.to_pylist() for c in columns)
                out = out.filter(pa.array([x != y for x, y in zip(first, second)], pa.bool_()))
            yield out

    return run


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, width: int = 3000, least: int = 3, least_gain: float = 5.0,
    pairs: int = 20_000, **options,
) -> Model:
    """Fit on at most `fit_rows` labelled documents, in the order of a hash of the id, `width`
    features and `pairs` swapped sentences, which bounds what the driver holds.

    Null labels do not count; of several labels of a document the largest holds. A feature
    needs `least` documents and that gain in log likelihood. Without labels every text scores zero.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(chosen, "doc_id")
    sample = sample.select("text", F.col("toxic").cast("int").alias("toxic"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [t.as_py().decode("utf-8", "replace").lower() for t in part.column(0)]
                rows = [sorted(features(set(_WORD.findall(t)))) for t in texts]
                found = [list(swapped_pairs(t)) for t in texts]
                yield batch(
                    toxic=part.column(1),
                    found=pa.array(rows, pa.list_(pa.int32())),
                    before=pa.array([[sorted(x) for x, _ in f] for f in found], pa.list_(pa.list_(pa.int32()))),
                    after=pa.array([[sorted(x) for _, x in f] for f in found], pa.list_(pa.list_(pa.int32()))),
                )

    schema = "toxic int, found array<int>, before array<array<int>>, after array<array<int>>"
    rows = store(sample.mapInArrow(extract, schema), "toxicity-sample")
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    counts = (
        rows.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("k"))
    )

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    ratio = sum(
        part(seen, of * total / max(n, 1))
        for seen, of, total in ((a, k, n1), (k - a, k, n - n1), (n1 - a, n - k, n1), (n - n1 - k + a, n - k, n - n1))
    )
    best = counts.where(F.col("k") >= least).select("f", ratio.alias("g")).where(F.col("g") > least_gain)
    wanted = {r.f for r in best.orderBy(F.desc("g"), "f").limit(width).collect()}
    wanted |= {f for line in IDENTITY_TERMS for term in line for f in word_features(term)}
    names = np.array(sorted(wanted), np.int32)
    if n > fit_rows:  # an id may have many rows
        rows = rows.limit(fit_rows)
    kept = rows.select("toxic", "found").mapInArrow(_placed(names), "toxic int, found array<int>").toArrow()
    swaps = rows.select(F.explode(F.arrays_zip("before", "after")).alias("p")).select("p.before", "p.after")
    swaps = swaps.mapInArrow(_placed(names), "before array<int>, after array<int>").limit(pairs).toArrow()
    toxic = kept.column("toxic").to_numpy().astype(float)
    return train(names, Rows.of(kept.column("found")), toxic, Rows.of(swaps.column("before")), Rows.of(swaps.column("after")), **options)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns and a last one, `name`: the probability of the toxic label from the text
    alone. A null text scores as an empty one; texts are used whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            values = [of(t.as_py().decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values, pa.float64())], names)

    names = [f"c{i}" for i in range(len(docs.columns))] + ["toxicity"]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema)) + ", toxicity double"
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), utf8(F.col("text")).alias("bytes"))
    return rows.mapInArrow(run, schema).toDF(*docs.columns, name)
