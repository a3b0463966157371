"""Language identification of words, spans and documents.

The scripts of a word's letters narrow the languages it can belong to. Each word then gets a
score per language from character n-grams, and Viterbi with a penalty for every switch of
language labels the words. Neighbouring words of one label are a span; the language that
holds most letters is the document's.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import batch, slices, store, utf8

UNKNOWN = "und"
#: First and last code point of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}
# A word has letters only, but Python counts all numerals to the word characters. A pattern that names
# them would try each of them on every letter, so it only cuts the few runs that hold one.
_NUMERALS = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")
_RUNS = re.compile(r"[^\W\d_]+")
_ASCII = re.compile(r"[a-z]+\Z")
_RANGES = sorted((low, high, 1 << i) for i, ranges in enumerate(SCRIPTS.values()) for low, high in ranges)
_OTHER = 1 << len(SCRIPTS)
SIZES = (1, 2, 3)
OUT = -1e4  # score of a language whose scripts a word does not have
BLOCK = 64


def scripts(word: str) -> int:
    """Bits of the scripts of a word's letters."""
    if _ASCII.match(word):
        return 1
    found = 0
    for char in set(word):
        point = ord(char)
        found |= next((bit for low, high, bit in _RANGES if low <= point <= high), _OTHER)
    return found


def words_of(text: str) -> list[str]:
    runs = _RUNS.findall(unicodedata.normalize("NFC", text).lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in ([run] if run.isalpha() else _LETTERS.findall(run))]


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of a text begin and end."""
    places: list[tuple[int, int]] = []
    for run in _RUNS.finditer(text):
        words = [run] if run[0].isalpha() else _LETTERS.finditer(text, *run.span())
        places += (word.span() for word in words)
    return places


def grams(word: str) -> list[str]:
    edged = f"^{word}$"
    return [edged[i : i + n] for n in SIZES for i in range(n == 1, len(edged) - n + 1 - (n == 1))]


@dataclass
class Model:
    """Languages in order, their script bits, and log shares of n-grams per language."""

    languages: list[str]
    script_bits: np.ndarray
    shares: dict[str, np.ndarray]
    unseen: np.ndarray

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores per word and language, the best being zero, and whether a word has the
        scripts of any language; without one its scores are zero everywhere."""
        if not hasattr(self, "table"):
            self.place = {g: i for i, g in enumerate(self.shares, 1)}
            self.table = np.array([self.unseen, *self.shares.values()], np.float32)
        get = self.place.get
        found = [[get(g, 0) for g in grams(w)] for w in words]
        starts = np.cumsum([0, *map(len, found)])[:-1]
        flat = np.fromiter((i for f in found for i in f), np.int64)
        total = np.add.reduceat(self.table[flat], starts, axis=0)
        fits = (self.script_bits[None, :] & np.fromiter(map(scripts, words), np.int64, len(words))[:, None]) != 0
        total -= np.where(fits, total, -np.inf).max(1, keepdims=True, initial=-1e9)
        known = fits.any(1)
        return np.where(known[:, None], np.where(fits, total, OUT), 0.0).astype(np.float32), known


def fit(
    docs: DataFrame, per_language: int = 2000, n_grams: int = 60_000, text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Count n-grams in about `per_language` documents of each language, picked by a hash of
    the text; rows with a null language or text do not count. `n_grams` bounds the model."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    sample = known.join(F.broadcast(sizes), "lang").where(share * F.col("n") < per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter()
            letters = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, k in Counter(words_of(text.as_py().decode("utf-8", "replace"))).items():
                    for g in grams(word):
                        seen[lang, g] += k
                    letters[lang, scripts(word)] += k * len(word)
            rows = [(*key, k) for key, k in seen.items()] + [(lang, f"\n{bits}", k) for (lang, bits), k in letters.items()]
            for at in range(0, len(rows), 50_000):
                lang, gram, k = zip(*rows[at : at + 50_000])
                yield batch(lang=list(lang), gram=list(gram), k=list(k))

    rows = sample.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, gram string, k long")
    counts = store(rows.groupBy("lang", "gram").agg(F.sum("k").alias("k")), "language-counts")
    total = counts.groupBy("gram").agg(F.sum("k").alias("all"))
    special = F.col("gram").startswith("\n")
    kept = total.where(~special).orderBy(F.desc("all"), "gram").limit(n_grams).select("gram")
    found = counts.join(kept.union(total.where(special).select("gram")), "gram").collect()
    return build([tuple(r) for r in found])


def build(rows: list[tuple[str, str, int]]) -> Model:
    """From (gram, lang, count); grams that begin with a line break count letters by script."""
    languages = sorted({lang for _, lang, _ in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    width = len(languages)
    letters, seen = Counter(), {}
    for gram, lang, k in rows:
        if gram[0] == "\n":
            for i in range(len(SCRIPTS) + 1):
                if int(gram[1:]) >> i & 1:
                    letters[lang, 1 << i] += k
        else:
            seen.setdefault(gram, np.zeros(width))[place[lang]] += k
    bits = np.zeros(width, np.int64)
    for lang in languages:
        total = sum(k for (name, _), k in letters.items() if name == lang)
        bits[place[lang]] = sum(bit for (name, bit), k in letters.items() if name == lang and k >= 0.01 * total)
    totals = sum(seen.values(), np.zeros(width))
    smooth, base = 0.5, np.log(totals + 0.5 * (len(seen) + 1))
    shares = {g: np.log(v + smooth) - base for g, v in seen.items()}
    return Model(languages, bits, shares, np.log(smooth) - base)


def best_path(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word. `scores` holds the documents' words one after another.

    Documents are cut into blocks of words. All blocks step through their words together, for
    every label they may start from; a pass over the blocks of each document then picks the
    starts, and the labels are read back block by block. A step keeps the label or pays the
    penalty; ties keep the label, and else take the first language.
    """
    width = scores.shape[1]
    per_doc = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
    n_blocks = int(first[-1])
    if not n_blocks:
        return np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    place = np.repeat(first[:-1] * BLOCK - offsets, lengths) + np.arange(len(scores))
    padded = np.zeros((n_blocks * BLOCK, width), np.float32)
    padded[place] = scores
    steps = padded.reshape(n_blocks, BLOCK, width)
    # from every start label i to every label j, over the words of a block
    value = np.where(np.eye(width, dtype=bool), 0.0, np.float32(-penalty)).astype(np.float32)
    value = np.repeat(value[None], n_blocks, 0)
    stay = np.zeros((BLOCK, n_blocks, width, width), bool)
    source = np.zeros((BLOCK, n_blocks, width), np.int16)
    stay[0] = True
    value = value + steps[:, 0, None, :]
    for t in range(1, BLOCK):
        source[t] = value.argmax(2)
        moved = value.max(2, keepdims=True) - np.float32(penalty)
        stay[t] = value >= moved
        value = np.where(stay[t], value, moved) + steps[:, t, None, :]
    # the end of a block is the start of the next one
    order = np.argsort(-per_doc, kind="stable")
    many, reach = per_doc[order], first[:-1][order]
    start_of = np.zeros((n_blocks, width), np.int16)
    last = np.zeros((len(many), width), np.float32)
    for k in range(int(many[0])):
        active = int(np.searchsorted(-many, -k, "left"))
        through = last[:active, :, None] + value[reach[:active] + k]
        start_of[reach[:active] + k] = through.argmax(1)
        last[:active] = through.max(1)
    label = last.argmax(1)
    ends, starts = np.zeros(n_blocks, np.int64), np.zeros(n_blocks, np.int64)
    for k in range(int(many[0]) - 1, -1, -1):
        active = int(np.searchsorted(-many, -k, "left"))
        blocks = reach[:active] + k
        ends[blocks] = label[:active]
        label[:active] = starts[blocks] = start_of[blocks, label[:active]]
    out = np.zeros((n_blocks, BLOCK), np.int64)
    now, every = ends, np.arange(n_blocks)
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = now
        kept = stay[t, every, starts, now]
        now = np.where(kept, now, source[t, every, starts])
    return out.reshape(-1)[place]


class Labeller:
    """Labels words; what is known of words seen before is kept up to a bound."""

    def __init__(self, model: Model, penalty: float, kept_words: int = 300_000):
        self.model, self.penalty, self.kept_words = model, penalty, kept_words
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, max(1, len(model.languages))), np.float32)
        self.known = np.zeros(0, bool)

    def _learn(self, words: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The kept scores and flags with those of more words after them."""
        scores, known = [self.scores], [self.known]
        for at in range(0, len(words) if self.model.languages else 0, 20_000):
            some, sure = self.model.score_words(words[at : at + 20_000])
            scores.append(some)
            known.append(sure)
        place.update((w, i) for i, w in enumerate(words, len(self.known)))
        if not self.model.languages:
            scores.append(np.zeros((len(words), 1), np.float32))
            known.append(np.zeros(len(words), bool))
        return np.concatenate(scores), np.concatenate(known)

    def label(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For the words of all documents one after another: label, and whether it is sure."""
        fresh = list(set().union(*docs).difference(self.place))
        room = max(0, self.kept_words - len(self.place))
        self.scores, self.known = self._learn(fresh[:room], self.place)
        place, scores, known = self.place, self.scores, self.known
        if fresh[room:]:  # no room left: for this call only
            more: dict[str, int] = {}
            scores, known = self._learn(fresh[room:], more)
            place = {**more, **{w: self.place[w] for w in set().union(*docs) if w in self.place}}
        lengths = np.array([len(d) for d in docs], np.int64)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(docs)), np.int64, int(lengths.sum()))
        return best_path(scores[at], lengths, self.penalty), known[at]


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if asked, spans (start, end, lang) of every document.

    lang_pred holds most of the letters, the first name of equals; score is its share of all
    letters. A text that is null or has no letter is `und` with score 0, and so is every text
    when no language was learned. A text with letters only of scripts that no learned language
    has gets the language with the most text in the sample, with score 0. A null id stays null.
    Span ends are exclusive, in characters of the text.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = model.languages
    common = int(np.argmin(model.unseen)) if names else 0  # the more text, the lower the share of what is unseen

    def rows_of(texts: list[str], labeller: Labeller) -> tuple[list[str], list[float]]:
        docs_words = [words_of(t) for t in texts]
        path, known = labeller.label(docs_words)
        sizes = np.fromiter(map(len, chain.from_iterable(docs_words)), np.int64, len(path))
        doc = np.repeat(np.arange(len(texts)), [len(d) for d in docs_words])
        width = max(1, len(names))
        letters = np.bincount(doc * width + path, sizes * known, len(texts) * width).reshape(-1, width)
        total = np.maximum(1, np.bincount(doc, sizes, len(texts)))
        most = letters.max(1)
        best = np.where(most > 0, letters.argmax(1), common)
        some = [bool(words and names) for words in docs_words]
        return [names[k] if s else UNKNOWN for k, s in zip(best.tolist(), some)], (most / total).tolist()

    def spans_of(text: str, labeller: Labeller) -> list[dict]:
        places = word_places(text)
        path, known = labeller.label([[text[start:end].lower() for start, end in places]])
        found: list[dict] = []
        for (start, end), k, sure in zip(places, path.tolist(), known.tolist()):
            lang = names[k] if sure else UNKNOWN
            if found and found[-1]["lang"] == lang:
                found[-1]["end"] = end
            else:
                found.append({"start": start, "end": end, "lang": lang})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for b in batches:
            texts = [t.as_py().decode("utf-8", "replace") for t in b.column(1)]
            most = max(20_000, 40_000_000 // max(1, len(names)) ** 2)
            for low, high in slices(np.fromiter(map(len, texts), np.int64, len(texts)), min(most, 2_000_000)):
                lang, score = rows_of(texts[low:high], labeller)
                columns = {"doc_id": b.column(0).slice(low, high - low), "lang_pred": lang, "score": score}
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    columns["spans"] = pa.array([spans_of(t, labeller) for t in texts[low:high]], kind)
                yield batch(**columns)

    schema = f"doc_id {id_type}, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<start:int,end:int,lang:string>>"
    return docs.select("doc_id", utf8(F.col("text"))).mapInArrow(run, schema)
