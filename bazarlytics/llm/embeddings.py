"""Near-duplicate vectors by an exact metric range join.

Pivots part the unit vectors into cells, each vector living at its nearest pivot. By the
triangle inequality a vector can only have a partner in another cell if its distance to that
cell's pivot is at most the cell's radius plus the range, and at most its distance to its
own pivot plus twice the range; it visits the cells for which both hold. Cells then join
independently. Of two partners from different cells, the one with the later cell visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.blocks import OWN, PARTNER, deal, grouped, whole_blocks
from bazarlytics.llm.common import batch, store
from bazarlytics.llm.graph import connected_components, forest

BLOCK = 2048
MOST_PIVOTS = 1024


def comparable(vector: Column, size: int) -> Column:
    """Whether a vector has a direction: full length, finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array, kind: str) -> np.ndarray:
    values = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    values /= np.abs(values).max(1, keepdims=True)  # so that no square overflows
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _links(units: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with cosine >= least. Single precision decides where its error
    cannot matter, double precision the rest."""
    single, margin = units.astype(np.float32), max(1e-5, units.shape[1] * 4e-7)
    cosine = single[left] @ single[right].T
    p, q = np.nonzero(cosine >= np.float32(least - margin))
    sure = cosine[p, q] > least + margin
    doubtful = np.flatnonzero(~sure)
    for at in range(0, len(doubtful), 100_000):
        rows = doubtful[at : at + 100_000]
        sure[rows] = np.einsum("ij,ij->i", units[left[p[rows]]], units[right[q[rows]]]) >= least
    return left[p[sure]], right[q[sure]]


def _compare(frames: Iterator[pd.DataFrame], least: float, kind: str) -> Iterator[pd.DataFrame]:
    """Links as a spanning forest (a, b, null) and, per vector, the vectors linked (a, null, n)."""
    for frame, starts in whole_blocks(frames, 20_000):
        ids, copies, side = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["side"].to_numpy()
        units = _unit(pa.array(frame["data"], pa.binary()), kind)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        who, linked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
            rows = np.arange(low, high)
            others = rows[side[rows] == PARTNER]
            own = rows[side[rows] == OWN]
            homes = rows[side[rows] != PARTNER]
            for at in range(0, len(homes), 1024):
                mine = homes[at : at + 1024]
                found = [_links(units, mine, others, least)] if len(others) else []
                inner = mine[side[mine] == OWN]
                if len(inner):
                    p, q = _links(units, inner, own[np.searchsorted(own, inner[0]) :], least)
                    found.append((p[p < q], q[p < q]))
                for p, q in found:
                    if not len(p):
                        continue
                    nodes, at_ = np.unique(np.concatenate([p, q]), return_inverse=True)
                    counts = np.bincount(at_, np.concatenate([copies[q], copies[p]]), len(nodes))
                    who.append(ids[nodes])
                    linked.append(counts.astype(np.int64))
                    a, b = forest(ids[p], ids[q])
                    left.append(a)
                    right.append(b)
        a, b = forest(np.concatenate(left), np.concatenate(right))
        nodes, at_ = np.unique(np.concatenate(who), return_inverse=True)
        counts = np.bincount(at_, np.concatenate(linked), len(nodes)).astype(np.int64)
        yield pd.DataFrame(
            {
                "a": np.concatenate([a, nodes]),
                "b": pd.array(np.concatenate([b, nodes]), "Int64"),
                "n": np.concatenate([np.zeros(len(a), np.int64), counts]),
            }
        )


def _pivots(classes: DataFrame, n: int, per_cell: int, kind: str) -> np.ndarray:
    """Directions of vectors picked by a hash; as many as make cells of that size, but at most
    MOST_PIVOTS, since every task holds them. Larger cells are cut into blocks."""
    wanted = max(1, min(MOST_PIVOTS, -(-n // per_cell)))
    rows = classes.orderBy(F.xxhash64("data"), "id").limit(wanted).select("data").collect()
    return _unit(pa.array([bytes(r.data) for r in rows], pa.binary()), kind)


def _cells(classes: DataFrame, pivots: np.ndarray, reach: float, kind: str) -> DataFrame:
    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = _distances(_unit(b.column(0), kind), pivots)
            yield batch(cell=away.argmin(1).astype(np.int64), away=away.min(1))

    measured = classes.select("data").mapInArrow(radius, "cell long, away double")
    radii = np.full(len(pivots), -np.inf)
    for row in measured.groupBy("cell").agg(F.max("away").alias("r")).collect():  # a row per pivot
        radii[row["cell"]] = row["r"]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                away = _distances(_unit(part.column(2), kind), pivots)
                home = away.argmin(1)
                near = (away <= radii + reach) & (away <= away.min(1, keepdims=True) + 2 * reach)
                near &= np.arange(len(pivots)) < home[:, None]
                row, cell = np.nonzero(near)
                every = np.concatenate([np.arange(len(home)), row])
                taken = part.take(pa.array(every))
                yield batch(
                    cell=np.concatenate([home, cell]).astype(np.int64),
                    role=np.repeat([0, 1], [len(home), len(row)]).astype(np.int32),
                    id=taken.column(0), copies=taken.column(1), data=taken.column(2),
                )

    return classes.select("id", "copies", "data").mapInArrow(members, "cell long, role int, id long, copies long, data binary")


def _packed(vectors: DataFrame, column: str) -> tuple[DataFrame, str]:
    """The vectors as bytes, and the kind of number in them."""
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.array(v, kind).tobytes() for v in b.column(2).to_numpy(zero_copy_only=False)]
            yield batch(id=b.column(0), copies=b.column(1), data=pa.array(data, pa.binary()))

    return vectors.select("id", "copies", column).mapInArrow(run, "id long, copies long, data binary"), kind


def near_vectors(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", column: str = "embedding", per_cell: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors with cosine >= `least` (above zero) are linked. A vector that is null, zero, or holds
    null or non-finite components links with nothing, as does one whose length is not the most
    frequent one (the greater of equals) and one without an id. Equal vectors are one class
    with a number of copies, so copies make no pairs. Repeated ids stay as rows. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v"))
    sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("size")).count()
    size = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    good = comparable(F.col("v"), size["size"] if size else 0) & F.col("vec_id").isNotNull()
    classes = rows.where(good).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = store(classes, "vector-classes")
    packed, kind = _packed(classes, "v")
    packed = store(packed, "vector-bytes")
    n = packed.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    reach = float(np.sqrt(2.0 - 2.0 * least)) + 1e-6
    members = _cells(packed, _pivots(packed, n, per_cell, kind), reach, kind)
    dealt = grouped(deal(members, per_cell, "id"))
    found = store(dealt.mapInPandas(lambda f: _compare(f, least, kind), "a long, b long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("n = 0"), "a", "b")
    known = classes.select("id", "copies").join(counts, "id", "left")
    known = known.join(parts, known.id == parts.node, "left").select(
        "id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    known = classes.select("id", "v").join(known, "id").drop("id")
    linked = rows.where(good).join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
