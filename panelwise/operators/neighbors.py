"""Exact nearest neighbours without forming all pairs.

Pivots cut the space into cells. From each row's distance to its pivot follows a radius within
which its k nearest rows must lie, so a row is sent only to the cells that may need it (the
triangle inequality; after Lu et al., "Efficient processing of k nearest neighbor joins using
MapReduce", VLDB 2012). Both sides of a cell are then cut into blocks of bounded size, and every
pair of blocks keeps only its k best candidates per row. Nothing is dropped: all candidates that
can be among the k nearest are compared.

Where the cells spare few pairs (with many dimensions they spare none), rows are not sent by cell:
both sides are cut into a few blocks of up to ``BLOCK_BYTES``, so that a row is sent as often as there
are such blocks of the other side, and not once for every couple of thousand rows.

Within a pair of blocks of many dimensions a product of matrices finds the few pairs whose distances
are then computed from the vectors themselves (``bounded_search``).

Copies of one vector: any row needs at most k + 1 of them, those with the smallest ids, so a group
of copies is cut to those before it is sent anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BLOCK_ROWS = 2_000
MAX_PIVOTS = 8_192
FEW_BLOCKS = 5  # of each side, as long as they hold no more than BLOCK_BYTES
BLOCK_BYTES = 32 << 20
SPARED = 0.75  # cells are given up if they spare a smaller share of the pairs
MANY_DIMENSIONS = 8  # from here on distances are found by a product of matrices first
_SLICE = 4_000_000  # doubles in one distance slice


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of slices of ``a`` to all of ``b``."""
    step = max(1, _SLICE // max(1, b.shape[0] * b.shape[1]))
    for start in range(0, len(a), step):
        gap = a[start : start + step, None, :] - b[None, :, :]
        yield start, np.einsum("ijk,ijk->ij", gap, gap)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def nearest_neighbors(
    points: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    queries: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, neighbor, distance, rank) of the k nearest other rows of each row.

    Ties go to the smaller neighbour key. ``queries`` may hold the keys and vectors of a subset of
    the rows when only their neighbours are wanted.
    """
    spark = points.sparkSession
    pts = _points(points, key, vector)
    asked = pts if queries is None else _points(queries, key, vector)
    copies = W.Window.partitionBy("v").orderBy("id")
    kept = (
        pts.select("*", F.row_number().over(copies).alias("copy"))
        .where(F.col("copy") <= k + 1)
        .drop("copy")
    )
    n = pts.count()
    if n <= block_rows:
        return _ranked(_in_one_block(asked, kept, k), key, k)
    wanted = min(MAX_PIVOTS, max(1, math.ceil(n / block_rows)))
    pivots = [
        r["v"]
        for r in pts.orderBy(F.xxhash64("id"), "id").select("v", "id").limit(4 * wanted).collect()
    ]
    pivots = np.unique(np.array(pivots, dtype=np.float64).reshape(len(pivots), -1), axis=0)[:wanted]
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        centers = shared.value
        for batch in batches:
            vectors = _matrix(batch["v"])
            cell = np.zeros(len(batch), dtype=np.int32)
            far = np.zeros(len(batch))
            for start, d in _distances(vectors, centers):
                best = d.argmin(axis=1)
                cell[start : start + len(d)] = best
                far[start : start + len(d)] = np.sqrt(d[np.arange(len(d)), best])
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "cell": cell, "far": far})

    def placed_in(df: DataFrame) -> DataFrame:
        return df.mapInPandas(place, f"id bigint, v {dict(df.dtypes)['v']}, cell int, far double")

    placed = placed_in(kept)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    cells = {r["cell"]: (r["n"], r["far"]) for r in stats}
    reach = _reach(pivots, cells, k)
    asked_placed = placed_in(asked)
    asked_stats = {
        r["cell"]: (r["n"], r["far"])
        for r in asked_placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    }
    # A row s can matter to cell i only within (furthest query of i) + (reach of i) of its pivot.
    limits = np.full(len(pivots), -1.0)
    for cell, (_, far) in asked_stats.items():
        limits[cell] = (2 * far + reach[cell]) * (1 + 1e-9) + 1e-9
    shared_limits = spark.sparkContext.broadcast(limits)

    def count(batches):
        centers, limit = shared.value, shared_limits.value
        total = np.zeros(len(centers), dtype=np.int64)
        for batch in batches:
            for _, d in _distances(_matrix(batch["v"]), centers):
                total += (np.sqrt(d) <= limit[None, :]).sum(axis=0)
        yield pd.DataFrame({"cell": np.arange(len(centers), dtype=np.int32), "n": total})

    counted = kept.select("v").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    sent_sizes = {r["cell"]: r["n"] for r in counted.collect()}
    n_asked, n_kept = (sum(m for m, _ in sizes.values()) for sizes in (asked_stats, cells))
    met = sum(m * sent_sizes.get(cell, 0) for cell, (m, _) in asked_stats.items())
    if met > (1 - SPARED) * n_asked * n_kept:
        most = max(block_rows, BLOCK_BYTES // (8 * pivots.shape[1] + 128))  # a row is an object of its own in pandas
        ask_blocks, have_blocks = ([max(1, min(FEW_BLOCKS, -(-m // block_rows)), -(-m // most))] for m in (n_asked, n_kept))
        one = F.lit(0).alias("cell")
        return _ranked(_paired(asked.select("id", "v", one), kept.select("id", "v", one), ask_blocks, have_blocks, k), key, k)

    def send(batches):
        centers, limit = shared.value, shared_limits.value
        for batch in batches:
            vectors = _matrix(batch["v"])
            ids = batch["id"].to_numpy()
            for start, d in _distances(vectors, centers):
                rows, near = np.nonzero(np.sqrt(d) <= limit[None, :])
                for at in range(0, len(rows), 10_000):
                    chosen = rows[at : at + 10_000] + start
                    yield pd.DataFrame(
                        {
                            "id": ids[chosen],
                            "v": batch["v"].to_numpy()[chosen],
                            "cell": near[at : at + 10_000].astype(np.int32),
                        }
                    )

    sent = kept.mapInPandas(send, f"id bigint, v {dict(kept.dtypes)['v']}, cell int")
    ask_blocks = [
        max(1, math.ceil(asked_stats.get(i, (0, 0))[0] / block_rows)) for i in range(len(pivots))
    ]
    have_blocks = [max(1, math.ceil(sent_sizes.get(i, 0) / block_rows)) for i in range(len(pivots))]

    return _ranked(_paired(asked_placed.drop("far"), sent, ask_blocks, have_blocks, k), key, k)


def _points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Ids and vectors; floats stay floats until they are compared, as they take half the bytes."""
    kind = "array<float>" if dict(df.select(F.col(vector).alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v"))


def _paired(asked: DataFrame, rows: DataFrame, ask_blocks: list[int], have_blocks: list[int], k: int) -> DataFrame:
    """The candidates of every pair of a block of queries and a block of rows, by cell."""

    def blocks(df: DataFrame, own: list[int], other: list[int], own_name: str, other_name: str) -> DataFrame:
        count = F.get(F.lit(own), F.col("cell"))
        against = F.get(F.lit(other), F.col("cell"))
        return df.select(
            "id",
            "v",
            "cell",
            F.pmod(F.xxhash64("id"), count).cast("int").alias(own_name),
            F.explode(F.sequence(F.lit(0), against - 1)).alias(other_name),
        )

    left = blocks(asked, ask_blocks, have_blocks, "a", "b")
    right = blocks(rows, have_blocks, ask_blocks, "b", "a")
    by = ["cell", "a", "b"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by))
    return pairs.applyInPandas(_compare(k), _CANDIDATES)


_CANDIDATES = "id bigint, other bigint, d2 double"


def _in_one_block(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """All rows fit one block: no cells are needed."""
    one = F.lit(0).alias("cell")
    left, right = asked.select("id", "v", one), rows.select("id", "v", one)
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(_compare(k), _CANDIDATES)


def _compare(k: int):
    """The k best candidates of each query within one pair of blocks."""

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"id": [], "other": [], "d2": []})
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        other, have = rows["id"].to_numpy()[order], _matrix(rows["v"])[order]
        ids, asked = queries["id"].to_numpy(), _matrix(queries["v"])
        if have.shape[1] >= MANY_DIMENSIONS and len(have) > 8 * k:
            found, place, values, _ = bounded_search(ids, asked, other, have, k)
            return pd.DataFrame({"id": ids[found], "other": other[place], "d2": values})
        out = []
        for start, d in _distances(asked, have):
            own = ids[start : start + len(d)]
            d[own[:, None] == other[None, :]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            values = np.take_along_axis(d, best, axis=1)
            real = np.isfinite(values)
            found = {"id": np.repeat(own, real.sum(axis=1)), "other": other[best][real], "d2": values[real]}
            out.append(pd.DataFrame(found))
        return pd.concat(out, ignore_index=True)

    return compare


def bounded_search(
    ids: np.ndarray, asked: np.ndarray, other: np.ndarray, have: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k nearest of each query, with few distances taken from the vectors themselves.

    A product of matrices gives all squared distances but for its rounding, which is bounded by the
    lengths of the vectors. The k-th smallest and twice that bound are a limit that no neighbour can
    be above; the pairs below it are computed from the vectors as given. Returns rows of ``asked``,
    places in ``have``, squared distances, and how many of them were computed so.
    """
    center = have.mean(axis=0)
    q, x = asked - center, have - center
    q2, x2 = (q**2).sum(axis=1), (x**2).sum(axis=1)
    # Each of the sums of n products is off by n rounding steps of the lengths' product at most.
    slack = 8 * (have.shape[1] + 4) * np.finfo(float).eps * (q2.max() + x2.max())
    found, full = [], 0
    step = max(1, _SLICE // max(1, len(have)))
    for start in range(0, len(asked), step):
        at = slice(start, min(start + step, len(asked)))
        rough = q2[at, None] + x2[None, :] - 2 * (q[at] @ x.T)
        rough[ids[at, None] == other[None, :]] = np.inf
        last = min(k, len(have)) - 1
        limit = np.partition(rough, last, axis=1)[:, last] + 2 * slack
        row, place = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        gap = asked[start + row] - have[place]
        values = np.einsum("ij,ij->i", gap, gap)
        full += len(values)
        order = np.lexsort((other[place], values, row))
        row, place, values = row[order], place[order], values[order]
        begin = np.searchsorted(row, np.arange(at.stop - start))
        best = np.arange(len(row)) - begin[row] < k
        found.append((start + row[best], place[best], values[best]))
    return (*(np.concatenate([f[i] for f in found]) for i in range(3)), full)


def _ranked(candidates: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.Window.partitionBy("id").orderBy("d2", "other"))
    return (
        candidates.select("*", rank.alias("neighbor_rank"))
        .where(F.col("neighbor_rank") <= k)
        .select(
            F.col("id").alias(key),
            F.col("other").alias("neighbor"),
            F.sqrt("d2").alias("distance"),
            "neighbor_rank",
        )
    )


def _reach(pivots: np.ndarray, cells: dict[int, tuple[int, float]], k: int) -> np.ndarray:
    """Per cell: a distance from its pivot that surely covers k + 1 rows.

    Cells are taken in the order of how far their furthest row can be, until they hold k + 1 rows.
    """
    reach = np.full(len(pivots), np.inf)
    index = np.array(sorted(cells))
    counts = np.array([cells[i][0] for i in index])
    fars = np.array([cells[i][1] for i in index])
    for cell in range(len(pivots)):
        upper = np.sqrt(((pivots[index] - pivots[cell]) ** 2).sum(axis=1)) + fars
        order = np.argsort(upper)
        enough = np.searchsorted(np.cumsum(counts[order]), k + 1)
        if enough < len(order):
            reach[cell] = upper[order[enough]]
    return reach
