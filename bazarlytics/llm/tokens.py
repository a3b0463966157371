"""Token ids of whole texts with a tokenizers file, quick where words repeat.

Both supported kinds of tokenizer cut a text into words by a pattern and then encode each
word by itself. Under the pattern of lower-cased words no word holds white space, so a text is cut
straight into its words. Under the other one a word takes at most one space before it, so where no
white space follows a space, the chunks between spaces can be encoded by themselves. The ids of a
word or a chunk are looked up once and kept; what is kept is bounded in number. A text with characters beyond Latin letters and common punctuation, for which the
pattern here could cut otherwise, or with wider spaces, is encoded by the library as a whole, as is every text
under a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# Letters, numbers and white space below U+0250, as the Unicode categories have them.
_L = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t-\r \x85\xa0"
_WIDE = re.compile(r" \s")
_ODD = re.compile("[^\\t-\\r\\x20-\\x7e\\xa0-ɏ‐-‧€]")

# The word patterns of the two tokenizer kinds, over those sets.
_BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_LOWER_WORDS = rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+"  # most words are letters: tried first
_LOWER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# A byte as the character that stands for it in the vocabularies: visible Latin-1 characters
# stand for themselves, the other bytes take the next code points from 256 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPACE = "\u0120"
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def default_path(name: str) -> str:
    """Where the installed vocabulary files have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Kept(dict):
    """Results by key, found by a function when first asked for and kept while there is room."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(self) < self.most:
            self[key] = found
        return found


class Encoder:
    """Encodes texts to unsigned 32-bit little-endian ids, as the library does by default: a string
    of an added token is that token, so texts that hold one go to the library whole."""

    def __init__(self, path: str, kept: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        spec = json.loads(self.tokenizer.to_str())
        self.words, self.lower = self._pattern(spec)
        # without chunks beside them there is room for more words
        self.known_words, self.first = _Kept(self._word, 3 * kept if self.lower else kept), _Kept(self._chunk, kept)
        self.rest = _Kept(lambda chunk: self._chunk(" " + chunk), kept)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]

    @staticmethod
    def _pattern(spec: dict):
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
            return re.compile(_BYTE_LEVEL), False
        steps = [p.get("type") for p in before.get("pretokenizers", [])]
        forms = [p.get("type") for p in normal.get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and forms == ["NFC", "Replace", "Lowercase"]:
            split, level = before["pretokenizers"]
            if split["pattern"] == {"Regex": _LOWER_SPLIT} and split["invert"] and not level["use_regex"]:
                return re.compile(_LOWER_WORDS), True
        return None, False

    def _word(self, word: str) -> bytes:
        """Ids of a word, straight from the library's word model."""
        shown = word.replace(" ", _SPACE)
        if not (word.isascii() and word.isprintable()):
            shown = word.encode().decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: those of its words one after another."""
        if chunk.isalpha() and chunk.isascii():  # one word
            return self.known_words[chunk]
        return b"".join(map(self.known_words.__getitem__, self.words.findall(chunk)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at, total = [], 0, 0
        for i, text in enumerate(texts):  # a few million characters at a time
            total += len(text)
            if total > 4_000_000 or i == len(texts) - 1:
                out += self._encode(texts[at : i + 1])
                at, total = i + 1, 0
        return out

    def _cut(self, text: str) -> list[str] | None:
        """The words of a text to be lower-cased, otherwise the chunks between its spaces; none
        where the library has to cut it."""
        if self.words is None or _ODD.search(text) or any(t in text for t in self.added):
            return None
        if not self.lower:
            return None if _WIDE.search(text) else text.split(" ")
        lower = text.lower()
        if any(t in lower for t in self.added) or not unicodedata.is_normalized("NFC", text):
            return None
        return self.words.findall(lower)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        first, rest, word = self.first, self.rest.__getitem__, self.known_words.__getitem__
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            if parts is None
            else b"".join(map(word, parts))
            if self.lower
            else first[parts[0]] + b"".join(map(rest, parts[1:]))
            for t, parts in zip(texts, cut)
        ]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept with its chunks while the process lives: a worker process
    serves many tasks."""
    return Encoder(path)
