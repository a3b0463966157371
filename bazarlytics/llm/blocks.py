"""Deal the members of comparison cells into blocks of bounded size, whatever a cell holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import store

#: How a row takes part in its block: compared with its own kind and the partners, with the
#: partners only, or as a partner. Rows of a block are sorted by it.
OWN, LEFT, PARTNER = 0, 1, 2


def deal(members: DataFrame, block: int, salt: str) -> DataFrame:
    """Add `blk` and `side` to rows (cell, role, ...) so that every home row of a cell meets
    every other row of it in exactly one block, and no block holds over about 2 * block rows.

    role 0 is a home row, role 1 a visitor; visitors do not meet each other. Cells above
    the block size are cut by the hash of `salt` into chunks, and a block is a pair of
    chunks. The rows of each cell are counted first; only the large ones are listed.
    """
    counts = members.groupBy("cell").agg(
        F.count(F.when(F.col("role") == 0, 1)).alias("_h"), F.count(F.when(F.col("role") == 1, 1)).alias("_v")
    )
    large = store(
        counts.where((F.col("_h") > 0) & (F.col("_h") + F.col("_v") > block)).select(
            "cell",
            F.ceil(F.col("_h") / block).cast("int").alias("_ph"),
            F.ceil(F.col("_v") / block).cast("int").alias("_pv"),
        ),
        "large-cells",
    )
    all_ = F.col("_ph") + F.col("_pv")
    chunk = F.pmod(F.xxhash64(salt, F.lit(7)), F.when(F.col("role") == 0, F.col("_ph")).otherwise(F.col("_pv")))
    chunk = chunk.cast("int")

    def home(other):
        low, high = F.least(F.col("_c"), other), F.greatest(F.col("_c"), other)
        side = F.when(other == F.col("_c"), OWN).when(other < F.col("_c"), PARTNER).otherwise(LEFT)
        return F.struct((low * F.col("_all") + high).alias("blk"), side.alias("side"))

    def visitor(other):
        return F.struct((other * F.col("_all") + F.col("_ph") + F.col("_c")).alias("blk"), F.lit(PARTNER).alias("side"))

    joined = members.join(large, "cell", "left").withColumn("_all", all_).withColumn("_c", chunk)
    places = F.when(
        F.col("_ph").isNull(),
        F.array(F.struct(F.lit(0).alias("blk"), F.when(F.col("role") == 0, OWN).otherwise(PARTNER).alias("side"))),
    ).when(
        F.col("role") == 0, F.transform(F.sequence(F.lit(0), F.col("_all") - 1), home)
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("_ph") - 1), visitor))
    kept = [c for c in members.columns if c != "role"]
    return joined.select(*kept, F.explode(places).alias("_p")).select(*kept, "_p.blk", "_p.side")


def grouped(df: DataFrame) -> DataFrame:
    """The dealt rows with those of a block beside each other."""
    return df.repartition("cell", "blk").sortWithinPartitions("cell", "blk", "side")


def whole_blocks(frames: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold whole blocks only, with the row numbers at which blocks begin and the
    end. What follows the last change of block waits for the next frame."""
    rest: list[pd.DataFrame] = []
    held = 0
    for frame in frames:
        if not len(frame):
            continue
        rest.append(frame)
        held += len(frame)
        if held < most:
            continue
        joined = pd.concat(rest, ignore_index=True)
        starts = _starts(joined)
        last = starts[-1]
        if last:
            yield joined.iloc[:last], starts
        rest, held = [joined.iloc[last:].reset_index(drop=True)], len(joined) - last
    if rest:
        joined = pd.concat(rest, ignore_index=True)
        yield joined, np.append(_starts(joined), len(joined))


def _starts(frame: pd.DataFrame) -> np.ndarray:
    cell, blk = frame["cell"].to_numpy(), frame["blk"].to_numpy()
    changed = (cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1])
    return np.concatenate([[0], np.flatnonzero(changed) + 1])
