"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Pieces are dealt evenly over tasks. A task takes its pieces from long to short and puts
each into the open sequence for which the squared counts of open sequences per residual gap
become smallest, and opens one when none has room. Sequences that stay too loose are taken apart and
their pieces packed again over fewer tasks, until one task has seen those left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from bazarlytics.llm.common import batch, fresh, store, utf8
from bazarlytics.llm.tokens import encoder

GROUP = 30_000  # pieces that one task packs


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece.

    A document is its ids and the end id. One that is longer than a sequence is cut into full
    pieces from its end; only its first piece may be shorter. A null text is an empty one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = [], [], [], [], []
            found = encode([t.as_py().decode("utf-8", "replace") for t in b.column(1)])
            for key, ids in zip(b.column(0).to_pylist(), found):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (key, number, low, high - low, ids[4 * low : 4 * high])):
                        column.append(value)
            yield batch(
                doc_id=pa.array(out[0], b.column(0).type), piece=pa.array(out[1], pa.int32()),
                start=pa.array(out[2], pa.int64()), length=pa.array(out[3], pa.int64()), ids=pa.array(out[4], pa.binary()),
            )

    rows = docs.select("doc_id", utf8(F.col("text")))
    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of every size, and the number of bins."""
    counts = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        after, before = counts[: capacity - size + 1], counts[size:]
        change = np.where(before > 0, 2.0 * (after - before) + 2, np.inf)
        if before[0]:  # a filled bin leaves no gap to count
            change[0] = 1.0 - 2.0 * before[0]
        best = int(change.argmin())
        if np.isfinite(change[best]):
            gap = best + size
            counts[gap] -= 1
            chosen = open_bins[gap].pop()
        else:
            gap, chosen, made = capacity, made, made + 1
        bins[i], offsets[i] = chosen, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_bins[gap - size].append(chosen)
    return bins, offsets, made


def _packed(rows: DataFrame, size: str, n: int, capacity: int, level: int, group: int) -> DataFrame:
    """The rows with sequence_id, offset and fill, packed by tasks of equal numbers of rows."""
    tasks = max(1, -(-n // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        table = pa.Table.from_batches(held)
        sizes = table.column(size).to_numpy()
        bins, offsets, made = sum_of_squares(sizes, capacity)
        fill = np.bincount(bins, sizes, made).astype(np.int64)
        base = ((level << 24) + TaskContext.get().partitionId()) << 34
        for name, column in (("sequence_id", bins + base), ("offset", offsets), ("fill", fill[bins])):
            table = table.append_column(name, pa.array(column))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # round robin over sorted rows: even whatever repeats, and the same when a task is run again
    dealt = rows.repartition(tasks).mapInArrow(run, f"{schema}, sequence_id long, offset long, fill long")
    return store(dealt, f"packed-{level}")


def place(rows: DataFrame, length: str = "length", capacity: int = 2048, group: int = GROUP, loose: float = 0.98) -> DataFrame:
    """Add sequence_id and offset to rows of at most `capacity` tokens; all columns stay.

    Within a sequence the offsets are gapless from 0. Rows may be equal to each other. Rows
    that fill a sequence get one of their own. No rows give no rows. `loose` is the share of
    the capacity below which a sequence is taken apart for the next round. Columns that are
    called sequence_id or offset already are replaced.
    """
    rows = rows.drop("sequence_id", "offset")
    if all(isinstance(f.dataType, NumericType) for f in rows.schema):
        return _placed(rows, length, capacity, group, loose)
    # a task packs the lengths of its rows; what else they hold does not pass through it
    row, names = fresh("row", rows.columns), rows.columns
    kept = store(rows.withColumn(row, F.monotonically_increasing_id()), "pieces")
    found = _placed(kept.select(row, F.col(f"`{length}`").cast("long").alias("size")), "size", capacity, group, loose)
    joined = kept.join(found.select(row, "sequence_id", "offset"), row)
    return joined.select(*(F.col(f"`{c}`") for c in names), "sequence_id", "offset")


def _placed(rows: DataFrame, length: str, capacity: int, group: int, loose: float) -> DataFrame:
    given = rows.columns
    names = [f"c{i}" for i in range(len(given))]
    left = store(rows.toDF(*names), "pieces")
    size, level, tasks, done = names[given.index(length)], 0, 0, []
    while True:
        n = left.count()
        before, tasks = tasks, max(1, -(-n // group))
        packed = _packed(left, size, n, capacity, level, group)
        if tasks == 1 or level and tasks >= before:
            done.append(packed)
            break
        full = F.col("fill") >= int(capacity * loose)
        done.append(packed.where(full))
        left, level = packed.where(~full).select(*names), level + 1
    whole = reduce(DataFrame.union, done)
    return whole.select(*(F.col(c).alias(g) for c, g in zip(names, given)), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, in order of offset) and the doc_ids of every sequence; rows as
    from place(pieces(...)). A sequence holds at most its capacity, which bounds the group."""
    part = F.struct("offset", "ids", "doc_id")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
