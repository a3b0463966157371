"""Token ids in wavelet matrices: one compressed file per shard of documents.

A shard holds the ids of consecutive documents. Bit-planes run from the highest bit of an
id to the lowest, each ordered by the bits above it, so that a token's place on one plane
follows from ranks on the planes before. A plane is written in compressed chunks beside the
counts of ones before each chunk; access, counting and occurrence lookup read only the
chunks they touch.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.llm.common import batch, store, utf8
from bazarlytics.llm.tokens import encoder
from bazarlytics.session import scratch_path

MAGIC = b"WAVELET1"
CHUNK = 1 << 16  # bits of a plane in one compressed chunk
WORD = 64


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """A shard file: documents in order, their lengths, and the bit-planes of all ids."""
    press = zstandard.ZstdCompressor(level=3).compress
    ids = ids.astype(np.uint32)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    body, planes = [], []
    kind = np.uint16 if levels <= 16 else np.uint32

    def put(data: bytes) -> int:
        body.append(press(data))
        return len(body[-1])

    now = ids.astype(kind)
    for level in range(levels):
        bits = now & kind(1 << (levels - 1 - level)) != 0
        packed = np.packbits(bits, bitorder="little")
        ones = [int(np.count_nonzero(bits[at : at + CHUNK])) for at in range(0, len(bits), CHUNK)]
        sizes = [put(packed[at : at + CHUNK // 8].tobytes()) for at in range(0, len(packed), CHUNK // 8)]
        planes.append({"sizes": sizes, "ones": np.cumsum([0, *ones]).tolist()})
        now = np.concatenate([np.compress(~bits, now), np.compress(bits, now)])
    table = put(json.dumps({"doc_ids": doc_ids, "lengths": lengths}).encode())
    head = press(json.dumps({"n": len(ids), "levels": levels, "planes": planes, "documents": table}).encode())
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class Shard:
    """Reads one shard file; `source` is a seekable binary file or its bytes."""

    def __init__(self, source):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        self.expand = zstandard.ZstdDecompressor().decompress
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack("<I", self.file.read(4))
        head = json.loads(self.expand(self.file.read(size)))
        self.n, self.levels = head["n"], head["levels"]
        at, self.places, self.ones = len(MAGIC) + 4 + size, [], []
        for plane in head["planes"]:
            ends = np.cumsum([at, *plane["sizes"]]).tolist()
            self.places.append(list(zip(ends[:-1], plane["sizes"])))
            self.ones.append(np.array(plane["ones"], np.int64))
            at = ends[-1]
        self.zeros = [self.n - int(o[-1]) for o in self.ones]
        self.file.seek(at)
        table = json.loads(self.expand(self.file.read(head["documents"])))
        self.doc_ids, self.lengths = table["doc_ids"], table["lengths"]
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _chunk(self, level: int, number: int) -> np.ndarray:
        if (level, number) not in self._held:
            if len(self._held) >= 64:
                self._held.pop(next(iter(self._held)))
            at, size = self.places[level][number]
            self.file.seek(at)
            packed = np.frombuffer(self.expand(self.file.read(size)), np.uint8)
            self._held[level, number] = np.unpackbits(packed, bitorder="little")
        return self._held[level, number]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        number, rest = divmod(i, CHUNK)
        return int(self.ones[level][number]) + (int(self._chunk(level, number)[:rest].sum()) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of that value, from 0."""
        before = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * CHUNK, self.n) - self.ones[level]
        number = int(np.searchsorted(before, k, "right")) - 1
        return number * CHUNK + int(np.flatnonzero(self._chunk(level, number)[: self.n - number * CHUNK] == bit)[k - before[number]])

    def _step(self, level: int, bit: int, i: int) -> int:
        ones = self._rank1(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at a place of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._chunk(level, i // CHUNK)[i % CHUNK])
            i = self._step(level, bit, i)
            value = value << 1 | bit
        return value

    def _bounds(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            bit = token >> (self.levels - 1 - level) & 1
            low, high = self._step(level, bit, low), self._step(level, bit, high)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token occurs at the places low up to, not including, high."""
        first, last = self._bounds(token, low, self.n if high is None else high)
        return last - first

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        first, last = self._bounds(token, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i = first + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id of the shard in order: from the last plane up, the zeros and the ones of a plane
        go back to their places, and each one brings its bit."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            parts = []
            for at, size in self.places[level]:
                self.file.seek(at)
                parts.append(self.expand(self.file.read(size)))
            bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), count=self.n, bitorder="little").view(bool)
            zeros, below = self.zeros[level], np.empty(self.n, kind)
            below[np.flatnonzero(~bits)] = values[:zeros]
            below[np.flatnonzero(bits)] = values[zeros:] | kind(1 << (self.levels - 1 - level))
            values = below
        return values.astype(np.uint32)


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, shard_tokens: int = 2_000_000
) -> DataFrame:
    """Encode all texts, write the shard files and return their manifest.

    The manifest has one row per file: path, shard (part, number), n_docs, n_tokens, and base,
    the ids in all files before it. Documents go in ascending doc_id order (nulls first, equal
    ids by a hash of the text). A file takes documents until it holds `shard_tokens` ids; a
    document is never split. A null text is an empty one and holds the end id alone; an empty
    table gives no files. Each attempt of a task writes under its own name, and only files of
    the manifest count, so a lost executor leaves no half file behind.
    """
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "wavelet")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part, number = TaskContext.get().partitionId(), 0
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        ids, doc_ids, lengths, held = [], [], [], 0

        def flush():
            nonlocal ids, doc_ids, lengths, held, number
            data = pack(np.frombuffer(b"".join(ids), "<u4"), doc_ids, lengths)
            name = f"shard-{part:06d}-{number:04d}-{uuid.uuid4().hex}.wavelet"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = batch(part=[part], number=[number], path=[f"{folder}/{name}"], n_docs=[len(doc_ids)], n_tokens=[held])
            ids, doc_ids, lengths, held, number = [], [], [], 0, number + 1
            return row

        for b in batches:
            keys = b.column(0).to_pylist()
            texts = [t.as_py().decode("utf-8", "replace") for t in b.column(1)]
            for key, found in zip(keys, encode(texts)):
                ids.append(found + end)
                doc_ids.append(key)
                lengths.append(len(found) // 4 + 1)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = store(
        rows.mapInArrow(run, "part long, number long, path string, n_docs long, n_tokens long"), "wavelet-manifest"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        files.join(parts, "part")
        .withColumn("base", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .drop("_base")
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the manifest's files; start counts the ids of
    all documents before it, and ids are little-endian unsigned 32-bit integers."""
    tasks = max(1, min(10_000, manifest.count()))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, place = filesystem(path)
                with system.open_input_file(place) as source:
                    shard = Shard(source)
                    ids = shard.all_ids().astype("<u4")
                ends = np.cumsum([0, *shard.lengths])
                for at in range(0, len(shard.doc_ids), 500):
                    to = min(at + 500, len(shard.doc_ids))
                    yield batch(
                        doc_id=pa.array(shard.doc_ids[at:to], pa.int64()),
                        start=base + ends[at:to],
                        ids=[ids[ends[i] : ends[i + 1]].tobytes() for i in range(at, to)],
                    )

    rows = manifest.select("path", "base", "part", "number").repartitionByRange(tasks, "part", "number")
    return rows.select("path", "base").mapInArrow(run, "doc_id long, start long, ids binary")
