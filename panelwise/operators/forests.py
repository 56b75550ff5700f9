"""Forests of any depth with exact split points.

A tree is grown breadth first from histograms, as long as one of its nodes has more rows than one
task should hold; then the rows of each node go to one task, which grows the rest of the tree there
on the values themselves. The splits found breadth first are the same exact ones: sums between cut
points bound what a split inside an interval can gain, and the values of the intervals that may hold
the best split are compared themselves. The size of the table decides where a split is found, not
which; only in a regression on fractions the last digit of a sum may decide between equal splits.

Drawing with replacement is a Poisson number per row and tree, by a hash of the row's key, and the
features a node may split on are a hash of its path: a rerun, or another partitioning, draws the
same rows and features.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.session import new_table_path, written

#: Cut points of a feature in the histograms, at least and at most.
FEW_CUTS, MANY_CUTS = 255, 65_535
#: Cells of a histogram that a task holds before it passes them on.
HELD_CELLS = 500_000
#: Nodes whose histograms one job makes.
NODES_AT_ONCE = 512
#: A forest up to this size is sent to the tasks that predict; rows go to the trees of a larger one.
SENT_BYTES = 256 << 20
#: (row, tree) pairs that one job sends to the tasks that grow trees.
PAIRS_AT_ONCE = 2_000_000_000

NODE = (
    "tree int, branch bigint, node int, left int, right int, feature int, threshold double, "
    "rows bigint, weight double, value array<double>, gain double"
)
NODE_NAMES = [part.split()[0] for part in NODE.split(", ")]
NODE_TYPES = [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64()]


#: The labels of a batch of rows for one tree.
Target = Callable[[pa.RecordBatch, int], np.ndarray]


def own_label(batch: pa.RecordBatch, tree: int) -> np.ndarray:
    return batch["label"].to_numpy()


@dataclass(frozen=True)
class Growth:
    """``classes`` is None for a regression. A node is split while it has ``min_split`` rows, is
    not pure, and a split leaves ``min_leaf`` rows on either side; ``max_depth`` None is no limit.
    ``features`` is the number tried per node, None for all."""

    classes: int | None
    trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: int | None = None
    bootstrap: bool = True
    seed: int = 42
    task_rows: int = 200_000


# --------------------------------------------------------------------------------------------
# hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


def draws(marks: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean one."""
    if not growth.bootstrap:
        return np.ones(len(marks), dtype=np.int64)
    salt = _mixed(np.array([growth.seed * 1_000_003 + tree], dtype=np.uint64))
    u = (_mixed(marks.view(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right")


def root_path(tree: int, growth: Growth) -> np.uint64:
    return _mixed(np.array([growth.seed * 7919 + tree], dtype=np.uint64))[0]


def child_paths(paths: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(paths * np.uint64(2) + np.uint64(side))


def tried_features(splits: np.ndarray, paths: np.ndarray, tried: int | None) -> np.ndarray:
    """Which features (features, nodes) a node looks at, of those that have a split: the first
    ``tried`` in the order of the node, or the first with a split."""
    n = len(splits)
    if tried is None or tried >= n:
        return splits
    features = np.arange(n, dtype=np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D)
    place = np.argsort(np.argsort(_mixed(paths[None, :] ^ features), axis=0, kind="stable"), axis=0)
    place = np.where(splits, place, n)
    return splits & (place <= np.maximum(place.min(axis=0), tried - 1))


def choose_feature(gains: np.ndarray, paths: np.ndarray, tried: int | None) -> np.ndarray:
    """The feature each node is split on, from ``gains`` (features, nodes; -inf: no split): the best
    of the first ``tried`` in the order of the node, or the first with a split; -1 if none has one.
    Equal gains go to the smaller feature."""
    gains = np.where(tried_features(~np.isneginf(gains), paths, tried), gains, -np.inf)
    best = np.argmax(gains, axis=0)
    return np.where(np.isneginf(gains.max(axis=0)), -1, best)


# --------------------------------------------------------------------------------------------
# sums of rows


def row_sums(label: np.ndarray, weight: np.ndarray, classes: int | None) -> np.ndarray:
    """Columns that are summed over the rows of a node: weights per class, or weight and moments."""
    if classes is None:
        return np.stack([weight, weight * label, weight * label * label], axis=1)
    out = np.zeros((len(label), classes))
    out[np.arange(len(label)), label.astype(np.int64)] = weight
    return out


def score(sums: np.ndarray, classes: int | None) -> np.ndarray:
    """What a split makes as large as possible: summed over both sides, weight times purity."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if classes is None:
            return np.where(sums[..., 0] > 0, sums[..., 1] ** 2 / sums[..., 0], 0.0)
        # Few classes are added column by column: several times as fast, with the same digits.
        columns = np.moveaxis(sums, -1, 0) if sums.shape[-1] < 8 else None
        total = sums.sum(axis=-1) if columns is None else sum(columns[1:], columns[0])
        squares = (sums**2).sum(axis=-1) if columns is None else sum((c**2 for c in columns[1:]), columns[0] ** 2)
        return np.where(total > 0, squares / total, 0.0)


def is_pure(sums: np.ndarray, classes: int | None) -> np.ndarray:
    if classes is not None:
        total = sums.sum(axis=-1)
        return sums.max(axis=-1) >= total * (1 - 1e-12)
    weight = np.maximum(sums[..., 0], 1e-300)
    return sums[..., 2] / weight - (sums[..., 1] / weight) ** 2 <= 1e-15 * sums[..., 2] / weight


def outcome(sums: np.ndarray, classes: int | None, center: float) -> tuple[float, list[float]]:
    """Weight and value of a node: class weights, or the mean (labels are summed less ``center``)."""
    if classes is None:
        return float(sums[0]), [center + (float(sums[1] / sums[0]) if sums[0] else 0.0)]
    return float(sums.sum()), sums.tolist()


def outcomes(sums: np.ndarray, classes: int | None, center: float) -> tuple[np.ndarray, np.ndarray]:
    """``outcome`` of many nodes: weights, and values as rows of a matrix."""
    if classes is None:
        mean = np.divide(sums[:, 1], sums[:, 0], out=np.zeros(len(sums)), where=sums[:, 0] != 0)
        return sums[:, 0], (center + mean)[:, None]
    return sums.sum(axis=1), sums


# --------------------------------------------------------------------------------------------
# one subtree in one task


def grow_subtree(x: np.ndarray, label: np.ndarray, weight: np.ndarray, path: np.uint64, depth: int, growth: Growth, center: float = 0.0) -> dict[str, np.ndarray]:
    """Nodes of the tree over the rows of ``x``, level by level, as arrays; node 0 is its root. A
    leaf's threshold is nan.

    All nodes of a level are split at once: for each feature the rows lie in the order of node and
    value, where running sums give the gain of every split point. Gains are computed only of the
    features that a node looks at. Rows that lie in order stay so: those of a node's left child are
    moved before those of its right one.
    """
    n, n_features = x.shape
    sums = row_sums(label - center, weight, growth.classes)
    summed = [np.ascontiguousarray(c) for c in sums.T]
    scored = len(summed) if growth.classes is not None else 2  # squares have no part in a gain
    # A node's least and greatest value tell whether a feature splits it, where all can be compared.
    comparable = bool(np.isfinite(x).all() and np.isfinite(sums).all())
    margin = max(1, growth.min_leaf)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("left", "right", "feature", "threshold", "rows", "weight", "value", "gain")}
    orders = [np.argsort(x[:, f], kind="stable").astype(np.int32 if n < 1 << 31 else np.int64) for f in range(n_features)]
    rows = np.array([n])  # of each node of the level
    goes_to = np.zeros(n, dtype=np.int8)  # the side of its node that a row goes to; 2: it is done
    paths = np.array([path], dtype=np.uint64)
    first, level = 0, 1  # number of the level's first node, and of its nodes
    while level:
        begin = np.concatenate([[0], np.cumsum(rows)])
        at = np.repeat(np.arange(level, dtype=np.int32), rows)  # the node at each place of an order
        here = orders[0] if n_features else np.arange(n)
        total = np.stack([np.bincount(at, weights=c[here], minlength=level) for c in summed], axis=1)
        if growth.classes is not None:
            pure = is_pure(total, growth.classes)
        else:  # the labels themselves, as sums of squares are not exact
            own = label[here]
            pure = np.minimum.reduceat(own, begin[:-1]) >= np.maximum.reduceat(own, begin[:-1])
        open_ = (rows >= max(2, growth.min_split)) & ~pure
        if growth.max_depth is not None and depth >= growth.max_depth:
            open_[:] = False
        gains = np.full((n_features, level), -np.inf)
        cuts = np.zeros((n_features, level))
        looked = np.tile(open_, (n_features, 1))
        if comparable and open_.any():
            low = np.minimum(begin[:-1] + margin - 1, begin[1:] - 1)
            high = np.maximum(begin[1:] - margin, begin[:-1])
            for f in range(n_features):
                looked[f] &= (rows >= 2 * margin) & (x[orders[f][low], f] < x[orders[f][high], f])
            looked = tried_features(looked, paths, growth.features)
        for f in np.flatnonzero(looked.any(axis=1)):
            order = orders[f]
            own = np.flatnonzero(np.repeat(looked[f], rows))
            node, value = at.take(own), x[:, f].take(order.take(own))
            inner = np.flatnonzero((node[:-1] == node[1:]) & (value[:-1] < value[1:]))
            place, node = own.take(inner), node.take(inner)
            count = place + 1 - begin[node]
            if margin > 1:
                large = (count >= margin) & (rows[node] - count >= margin)
                inner, place, node = inner[large], place[large], node[large]
            if not len(place):
                continue
            left, right = (np.empty((len(place), scored), order="F" if scored < 8 else "C") for _ in range(2))
            for c in range(scored):
                running = np.cumsum(summed[c].take(order))
                before = np.concatenate([[0.0], running])[begin[:-1]]
                left[:, c] = running.take(place) - before.take(node)
                right[:, c] = total[:, c].take(node) - left[:, c]
            gain = score(left, growth.classes) + score(right, growth.classes)
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            best = np.full(level, -np.inf)
            best[node[starts]] = np.maximum.reduceat(gain, starts)
            chosen = np.flatnonzero(gain == best[node])
            chosen = chosen[np.concatenate([[True], node[chosen[1:]] != node[chosen[:-1]]])] if len(chosen) else chosen
            which = node[chosen]
            gains[f, which] = best[which]
            low, high = value[inner[chosen]], value[inner[chosen] + 1]
            middle = low / 2 + high / 2
            cuts[f, which] = np.where((middle >= low) & (middle < high), middle, low)
        feature = choose_feature(gains, paths, growth.features) if n_features else np.full(level, -1)
        split = np.flatnonzero(feature >= 0)
        number = np.full(level, -1)
        number[split] = 2 * np.arange(len(split))
        threshold = cuts[feature[split], split] if len(split) else np.zeros(0)
        gain = np.zeros(level)
        gain[split] = np.maximum(0.0, gains[feature[split], split] - score(total[split], growth.classes))
        cut = np.zeros(level)
        cut[split] = threshold
        child = np.where(number >= 0, first + level + number, -1)
        mass, value = outcomes(total, growth.classes, center)
        cells = (child, np.where(child >= 0, child + 1, -1), feature, np.where(number >= 0, cut, np.nan), rows, mass, value, gain)
        for name, cell in zip(out, cells):
            out[name].append(cell)
        # Rows of split nodes go to the children; the others are done.
        following = np.zeros(0, dtype=np.int64)
        if len(split):
            side = np.where(feature[at] < 0, 2, x[here, feature[at]] > cut[at]).astype(np.int8)
            goes_to[here] = side
            sizes = [np.bincount(at[side == k], minlength=level)[split] for k in (0, 1)]
            following = np.stack(sizes, axis=1).ravel()
            starts = np.concatenate([[0], np.cumsum(following)])[:-1]
            places = [np.arange(size.sum()) + np.repeat(starts[k::2] - (np.cumsum(size) - size), size) for k, size in enumerate(sizes)]
            for f in range(n_features):
                side = goes_to.take(orders[f])
                order = np.empty(len(places[0]) + len(places[1]), dtype=orders[f].dtype)
                for k in (0, 1):
                    order[places[k]] = orders[f][side == k]
                orders[f] = order
            paths = np.stack([child_paths(paths[split], 0), child_paths(paths[split], 1)], axis=1).ravel()
        rows = following
        first, level, depth = first + level, 2 * len(split), depth + 1
    return {name: np.concatenate(cells) for name, cells in out.items()}


# --------------------------------------------------------------------------------------------
# the upper part of a tree


@dataclass
class Top:
    """The upper part of one tree. A leaf is a branch, grown on in a task, unless it is ``done``."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    path: list[np.uint64]
    depth: list[int]
    rows: list[int]
    gain: list[float]
    value: list[tuple[float, list[float]] | None]
    done: list[bool]

    @classmethod
    def start(cls, path: np.uint64, rows: int) -> Top:
        return cls([-1], [0.0], [-1], [-1], [path], [0], [rows], [0.0], [None], [False])

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row falls into."""
        return descend(x, np.zeros(len(x), dtype=np.int64), *map(np.array, (self.feature, self.threshold, self.left, self.right)))

    def split(self, node: int, feature: int, threshold: float, rows: tuple[int, int], gain: float) -> None:
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for side in (0, 1):
            for column, cell in (
                (self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                (self.path, child_paths(np.array([self.path[node]], dtype=np.uint64), side)[0]),
                (self.depth, self.depth[node] + 1), (self.rows, rows[side]), (self.gain, 0.0), (self.value, None), (self.done, False),
            ):
                column.append(cell)


def descend(x: np.ndarray, at: np.ndarray, feature, threshold, left, right) -> np.ndarray:
    """The leaf that each row reaches from its node ``at``."""
    at = at.copy()
    moving = np.flatnonzero(left[at] >= 0)
    while len(moving):
        here = at[moving]
        goes = x[moving, feature[here]] <= threshold[here]
        at[moving] = np.where(goes, left[here], right[here])
        moving = moving[left[at[moving]] >= 0]
    return at


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def node_values(column: pa.ChunkedArray) -> np.ndarray:
    """The nodes' values as a matrix; zeros where a node has none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    out = np.zeros((len(column), int(lengths.max(initial=0)) or 1))
    out[lengths > 0] = pc.list_flatten(column).to_numpy().reshape(-1, out.shape[1])
    return out


def in_order(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """The vectors as a matrix whose rows are in the given order; the only copy that is made."""
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    out, at = None, 0
    for chunk in column.chunks:
        if len(chunk):
            part = matrix(chunk)
            out = np.empty((len(order), part.shape[1]), order="F") if out is None else out
            out[place[at : at + len(part)]] = part
            at += len(part)
    return np.zeros((0, 0)) if out is None else out


@dataclass
class Cuts:
    """Cut points of each feature; ``only`` is the value of each interval whose rows share one, else nan."""

    points: list[np.ndarray]
    only: list[np.ndarray]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """The interval of each value: up to a cut point, beyond the last, or nan."""
        return [np.where(np.isnan(x[:, f]), len(c) + 1, np.searchsorted(c, x[:, f], side="left")) for f, c in enumerate(self.points)]


def cut_points(rows: DataFrame, n: int, n_features: int, growth: Growth) -> Cuts | None:
    """Values that divide each feature's rows evenly, each once; None if one task holds all rows."""
    if n <= growth.task_rows or not n_features:
        return None
    cuts = min(MANY_CUTS, max(FEW_CUTS, -(-4 * n // growth.task_rows)))
    columns = rows.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(n_features)])
    shares = [i / (cuts + 1) for i in range(1, cuts + 1)]
    points = [np.unique(c) for c in columns.approxQuantile([f"x{i}" for i in range(n_features)], shares, 0.25 / cuts)]
    found = Cuts(points, [np.full(len(c) + 2, np.nan) for c in points])
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = ([np.full(len(c) + 2, side) for c in shared.value.points] for side in (np.inf, -np.inf))
        seen = [np.zeros(len(c) + 2, dtype=bool) for c in shared.value.points]
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["x"])
            for f, code in enumerate(shared.value.codes(x)):
                seen[f][code] = True
                np.minimum.at(low[f], code, x[:, f])
                np.maximum.at(high[f], code, x[:, f])
        for f in range(n_features):
            code = np.flatnonzero(seen[f][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), f)), pa.array(code), pa.array(low[f][code]), pa.array(high[f][code])], names=["feature", "code", "low", "high"])

    ends = rows.select("x").mapInArrow(run, "feature bigint, code bigint, low double, high double")
    for r in ends.groupBy("feature", "code").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").collect():  # an interval each
        found.only[r["feature"]][r["code"]] = r["low"]
    return found


def _slots(tops: list[Top], wanted: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Of each tree with wanted nodes, the slot of every node, or -1."""
    slot_of = {t: np.full(len(tops[t].feature), -1) for t in sorted({t for t, _ in wanted})}
    for slot, (t, node) in enumerate(wanted):
        slot_of[t][node] = slot
    return slot_of


#: Of a batch and a tree: the rows in wanted nodes, their slots, sums (rows, s0, ...) and labels.
Wanted = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _wanted_rows(batch: pa.RecordBatch, x: np.ndarray, tops: list[Top], slot_of: dict[int, np.ndarray], growth: Growth, center: float, target: Target, among: Callable[[int], np.ndarray] | None = None) -> Iterator[Wanted]:
    """The rows of each tree, of all or of those that ``among`` gives for it."""
    marks, weight = batch["mark"].to_numpy(), batch["weight"].to_numpy()
    for tree, slots in slot_of.items():
        mine = None if among is None else among(tree)
        drawn = draws(marks if mine is None else marks[mine], tree, growth)
        some = np.flatnonzero(drawn)
        mine, drawn = some if mine is None else mine[some], drawn[some]
        slot = slots[tops[tree].route(x[mine])] if len(mine) else np.zeros(0, dtype=np.int64)
        if len(there := np.flatnonzero(slot >= 0)) < len(slot):
            mine, drawn, slot = mine[there], drawn[there], slot[there]
        if len(mine):
            label = target(batch, tree)[mine]
            sums = row_sums(label - center, weight[mine] * drawn, growth.classes)
            yield tree, mine, slot, np.concatenate([np.ones((len(mine), 1)), sums], axis=1), label


def _histograms(rows: DataFrame, tops: list[Top], wanted: list[tuple[int, int]], cuts: Cuts, growth: Growth, center: float, target: Target) -> DataFrame:
    """(slot, feature, code, rows, s0, ...): sums over the rows of the wanted nodes by
    interval of a feature; of a regression also the range of a slot's labels (least, most), at the
    feature after the last. Tasks add up what they hold, Spark adds up the tasks."""
    spark = rows.sparkSession
    sizes = [len(c) + 2 for c in cuts.points]
    n_features = len(sizes)
    shared = spark.sparkContext.broadcast((tops, cuts, _slots(tops, wanted)))
    # Few intervals are added up in a table of all cells, many as pairs of a cell and its sums.
    few = sum(sizes) * len(wanted) <= HELD_CELLS
    width = growth.classes or 3
    names = [f"s{i}" for i in range(width)]
    ends = [] if growth.classes else ["least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, cuts, slot_of = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        cells = 0
        begin = np.concatenate([[0], np.cumsum(sizes)])
        table = np.zeros((len(wanted), begin[-1], width + 1)) if few else None
        least, most = np.full(len(wanted), np.inf), np.full(len(wanted), -np.inf)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            sums = np.zeros((len(keys), width + 1))
            np.add.at(sums, place, np.concatenate([s for _, s in held]))
            return keys, sums

        def passed(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            code, rest = keys % (MANY_CUTS + 2), keys // (MANY_CUTS + 2)
            columns = [rest // n_features, rest % n_features, code, sums[:, 0].astype(np.int64), *sums[:, 1:].T]
            none = [pa.nulls(len(keys), pa.float64())] * len(ends)
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], *none], names=["slot", "feature", "code", "rows", *names, *ends])

        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["x"])
            codes = cuts.codes(x)
            for tree, mine, slot, sums, label in _wanted_rows(batch, x, tops, slot_of, growth, center, target):
                if growth.classes is None:
                    np.minimum.at(least, slot, label)
                    np.maximum.at(most, slot, label)
                if few:
                    own = np.unique(slot_of[tree][slot_of[tree] >= 0])
                    place = np.searchsorted(own, slot)
                    for f, code in enumerate(codes):
                        size = sizes[f]
                        cell = place * size + code[mine]
                        for c in range(width + 1):
                            table[own, begin[f] : begin[f + 1], c] += np.bincount(cell, weights=sums[:, c], minlength=len(own) * size).reshape(-1, size)
                    continue
                for f, code in enumerate(codes):
                    held.append(((slot * n_features + f) * (MANY_CUTS + 2) + code[mine], sums))
                    cells += len(mine)
                    if cells > 4 * HELD_CELLS:
                        held = [merged()]
                        if len(held[0][0]) > HELD_CELLS:
                            yield passed(*held.pop())
                        cells = sum(len(k) for k, _ in held)
        if few:
            slot, at = np.nonzero(table[:, :, 0])
            f = np.searchsorted(begin, at, side="right") - 1
            yield passed((slot * n_features + f) * (MANY_CUTS + 2) + at - begin[f], table[slot, at])
        if held:
            yield passed(*merged())
        if growth.classes is None:
            slot = np.flatnonzero(least <= most)
            zero = np.zeros(len(slot), dtype=np.int64)
            columns = [slot, zero + n_features, zero, zero, *[zero.astype(float)] * width, least[slot], most[slot]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "feature", "code", "rows", *names, *ends])

    schema = "slot bigint, feature bigint, code bigint, rows bigint, " + ", ".join(f"{n} double" for n in [*names, *ends])
    made = rows.mapInArrow(run, schema)
    by = [F.sum(c).alias(c) for c in ("rows", *names)] + [side(c).alias(c) for side, c in zip((F.min, F.max), ends)]
    return made.groupBy("slot", "feature", "code").agg(*by)


def most_inside(before: np.ndarray, after: np.ndarray, total: np.ndarray, classes: int | None) -> np.ndarray:
    """What ``score`` of both sides cannot exceed at any split between two others, whose left sides
    sum to ``before`` and ``after``."""
    step = after - before
    if classes is None:
        # The score is convex in weight and sum, so greatest at a corner: sums are the interval's mean
        # times the weight so far, and at most half of its rows' distances from the mean besides.
        weight, sum_, squares = step.T
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = squares * (1 + 1e-12) - np.nan_to_num(sum_**2 / weight)
            reach = np.sqrt(np.maximum(weight * spread, 0.0)) / 2
            at = np.full(len(before), -np.inf)
            for end in (before, after):
                for left in (end[:, 1] - reach, end[:, 1] + reach):
                    rest = total[0] - end[:, 0]
                    both = np.where(end[:, 0] > 0, left**2 / end[:, 0], np.inf) + np.where(rest > total[0] * 1e-12, (total[1] - left) ** 2 / rest, np.inf)
                    at = np.maximum(at, both)
        return at

    # The score at the first split and, by class, the steepest rise that is possible from there on.
    def ends(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, most = low.sum(axis=1, keepdims=True), high.sum(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.nan_to_num(low / (low + most - high)), np.minimum(np.nan_to_num(high / (high + least - low), nan=0.0, posinf=1.0), 1.0)

    (low, high), (rest_low, rest_high) = ends(before, after), ends(np.maximum(total - after, 0.0), total - before)
    purest = np.minimum((rest_high**2).sum(axis=1), rest_high.max(axis=1))
    slope = 2 * high - (low**2).sum(axis=1, keepdims=True) - 2 * rest_low + purest[:, None]
    return score(before, classes) + score(total - before, classes) + (step * np.maximum(slope, 0.0)).sum(axis=1)


def _reaches(most: np.ndarray | float, gain: float) -> np.ndarray | bool:
    """Whether a bound allows the gain, but for rounding."""
    return most >= gain - 1e-9 * abs(gain)


CELLS = [
    ("slot", pa.int64()), ("feature", pa.int64()), ("gain", pa.float64()), ("code", pa.int64()), ("following", pa.int64()), ("left_rows", pa.int64()), ("rows", pa.int64()), ("total", pa.list_(pa.float64())),
    ("codes", pa.list_(pa.int64())), ("most", pa.list_(pa.float64())), ("rows_before", pa.list_(pa.int64())), ("before", pa.list_(pa.float64())), ("label_low", pa.float64()), ("label_high", pa.float64()),
]


def _best_cuts(histograms: DataFrame, cuts: Cuts, growth: Growth) -> DataFrame:
    """The best split between intervals of each node and feature, with the sums of the node, and the
    intervals whose values must be seen: those on either side of it and those that may hold a better one."""
    width = growth.classes or 3
    only = cuts.only

    def best(key: tuple, cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("code")
        slot, feature = key[0].as_py(), key[1].as_py()
        row = dict.fromkeys(name for name, _ in CELLS) | {"slot": slot, "feature": feature}
        if feature == len(only):
            row |= {"label_low": cells["least"][0].as_py(), "label_high": cells["most"][0].as_py()}
            return pa.Table.from_pylist([row], schema=pa.schema(CELLS))
        code, rows = cells["code"].to_numpy(), cells["rows"].to_numpy()
        sums = np.stack([cells[f"s{i}"].to_numpy() for i in range(width)], axis=1)
        total, n = sums.sum(axis=0), int(rows.sum())
        after, count = np.cumsum(sums, axis=0), np.cumsum(rows)
        before, rows_before = np.concatenate([np.zeros((1, width)), after[:-1]]), count - rows
        gain = (score(after, growth.classes) + score(total - after, growth.classes))[:-1]
        number = code < len(only[feature]) - 1  # not nan
        gain = np.where((count[:-1] >= growth.min_leaf) & (n - count[:-1] >= growth.min_leaf) & number[1:], gain, -np.inf)
        i = int(np.argmax(gain)) if len(gain) else -1
        found = i >= 0 and np.isfinite(gain[i])
        mixed = number & np.isnan(only[feature][code])
        most = most_inside(before, after, total, growth.classes)
        may = mixed & (rows > 1) & (count - 1 >= growth.min_leaf) & (n - rows_before - 1 >= growth.min_leaf) & _reaches(most, gain[i] if found else -np.inf)
        beside = np.zeros(len(code), dtype=bool)
        if found:
            beside[i : i + 2] = mixed[i : i + 2]
            row |= {"gain": float(gain[i]), "code": int(code[i]), "following": int(code[i + 1]), "left_rows": int(count[i])}
        seen = np.flatnonzero(may | beside)
        # An interval that is looked at for its ends only cannot hold a better split.
        most = np.where(may, most, -np.inf)
        row |= {"rows": n, "total": total.tolist(), "codes": code[seen].tolist(), "most": most[seen].tolist(), "rows_before": rows_before[seen].tolist(), "before": before[seen].ravel().tolist()}
        return pa.Table.from_pylist([row], schema=pa.schema(CELLS))

    schema = "slot bigint, feature bigint, gain double, code bigint, following bigint, left_rows bigint, rows bigint, total array<double>, codes array<bigint>, most array<double>, rows_before array<bigint>, before array<double>, label_low double, label_high double"
    return histograms.groupBy("slot", "feature").applyInArrow(best, schema)


#: Of an interval: rows and sums of the node before it, and all of the node.
Asked = dict[tuple[int, int, int], tuple[int, np.ndarray, int, np.ndarray]]


def _inside(rows: DataFrame, tops: list[Top], wanted: list[tuple[int, int]], cuts: Cuts, asked: Asked, growth: Growth, center: float, target: Target) -> DataFrame:
    """(slot, feature, code, low, high, gain, threshold, left_rows): of each asked interval its least
    and greatest value in the node, and the best split between two of its values, if there is one."""
    width, n_features = growth.classes or 3, len(cuts.points)
    names = [f"s{i}" for i in range(width)]
    of_slot: dict[tuple[int, int], list[int]] = {}
    for slot, feature, code in sorted(asked):
        of_slot.setdefault((wanted[slot][0], feature), []).append(slot * (MANY_CUTS + 2) + code)
    keys = {k: np.array(v) for k, v in of_slot.items()}
    # Most rows are in no asked interval of any node of their tree: they are left out first.
    open_ = {k: np.isin(np.arange(len(cuts.points[k[1]]) + 2), v % (MANY_CUTS + 2)) for k, v in keys.items()}
    slot_of = _slots(tops, wanted)
    slots = {slot for slot, _, _ in asked}
    slot_of = {t: np.where(np.isin(s, list(slots)), s, -1) for t, s in slot_of.items() if np.isin(s, list(slots)).any()}
    shared = rows.sparkSession.sparkContext.broadcast((tops, cuts, slot_of, keys, open_, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, cuts, slot_of, keys, open_, _ = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cells = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, value, sums = (np.concatenate(part) for part in zip(*held))
            order = np.lexsort((value, key))
            key, value = key[order], value[order]
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])]))
            return key[starts], value[starts], np.add.reduceat(sums[order], starts, axis=0)

        def passed(key: np.ndarray, value: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            code, rest = key % (MANY_CUTS + 2), key // (MANY_CUTS + 2)
            columns = [rest // n_features, rest % n_features, code, value, sums[:, 0].astype(np.int64), *sums[:, 1:].T]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "feature", "code", "value", "rows", *names])

        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["x"])
            codes = cuts.codes(x)
            near = lambda tree: np.flatnonzero(np.logical_or.reduce([open_[tree, f][code] for f, code in enumerate(codes) if (tree, f) in open_]))
            for tree, mine, slot, sums, _ in _wanted_rows(batch, x, tops, slot_of, growth, center, target, near):
                for f, code in enumerate(codes):
                    if (tree, f) not in keys:
                        continue
                    own, code = keys[tree, f], code[mine]
                    here = slot * (MANY_CUTS + 2) + code
                    hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here)
                    if len(hit):
                        held.append(((slot[hit] * n_features + f) * (MANY_CUTS + 2) + code[hit], x[mine[hit], f], sums[hit]))
                        cells += len(hit)
                    if cells > 4 * HELD_CELLS:
                        held = [merged()]
                        if len(held[0][0]) > HELD_CELLS:
                            yield passed(*held.pop())
                        cells = sum(len(k) for k, _, _ in held)
        if held:
            yield passed(*merged())

    def best(key: tuple, cells: pa.Table) -> pa.Table:
        slot, feature, code = (k.as_py() for k in key)
        rows_before, before, n, total = shared.value[-1][slot, feature, code]
        cells = cells.sort_by([(c, "ascending") for c in ("value", "rows", *names)])  # whatever the tasks
        value = cells["value"].to_numpy()
        last = np.flatnonzero(np.append(value[1:] != value[:-1], True))
        count = rows_before + np.cumsum(cells["rows"].to_numpy())[last][:-1]
        left = before + np.cumsum(np.stack([cells[c].to_numpy() for c in names], axis=1), axis=0)[last][:-1]
        value = value[last]
        gain = score(left, growth.classes) + score(total - left, growth.classes)
        gain = np.where((count >= growth.min_leaf) & (n - count >= growth.min_leaf), gain, -np.inf)
        i = int(np.argmax(gain)) if len(gain) else -1
        found = i >= 0 and np.isfinite(gain[i])
        row = {"slot": slot, "feature": feature, "code": code, "low": float(value[0]), "high": float(value[-1]), "gain": float(gain[i]) if found else None, "threshold": _between(float(value[i]), float(value[i + 1])) if found else None, "left_rows": int(count[i]) if found else None}
        return pa.Table.from_pylist([row], schema=pa.schema([(c, pa.int64() if c in ("slot", "feature", "code", "left_rows") else pa.float64()) for c in row]))

    made = rows.mapInArrow(run, "slot bigint, feature bigint, code bigint, value double, rows bigint, " + ", ".join(f"{c} double" for c in names))
    return made.groupBy("slot", "feature", "code").applyInArrow(best, "slot bigint, feature bigint, code bigint, low double, high double, gain double, threshold double, left_rows bigint")


def _between(low: float, high: float) -> float:
    middle = low / 2 + high / 2
    return middle if low <= middle < high else low


@dataclass
class _Node:
    """A node to split: what is known of its features, and the intervals to look into."""

    paths: np.ndarray
    known: dict[int, dict]
    growth: Growth
    n_features: int

    def asked(self) -> list[tuple[int, int]]:
        """(feature, place among the feature's intervals) whose values must be seen."""
        sure = np.zeros((self.n_features, 1), dtype=bool)
        may = np.zeros((self.n_features, 1), dtype=bool)
        for f, r in self.known.items():
            sure[f] = r["gain"] is not None
            may[f] = sure[f] or bool(r["codes"])
        if (may & ~sure).any():  # which features have a split, hence which are tried, is not known yet
            return [(f, i) for f, r in self.known.items() for i in range(len(r["codes"]))]
        tried = np.flatnonzero(tried_features(sure, self.paths, self.growth.features)[:, 0])
        reached = max((self.known[f]["gain"] for f in tried), default=-np.inf)
        out = []
        for f in tried:
            r = self.known[f]
            for i, (code, most) in enumerate(zip(r["codes"], r["most"])):
                if _reaches(most, reached) or r["gain"] >= reached and code in (r["code"], r["following"]):
                    out.append((int(f), i))
        return out

    def best(self, inside: dict[tuple[int, int], dict], only: list[np.ndarray]) -> tuple[int, float, int, float] | None:
        """Feature, threshold, rows to the left and gain of the split."""
        splits: dict[int, tuple[float, int, dict | None]] = {}
        for f, r in self.known.items():
            # Equal gains go to the smaller threshold; a split inside an interval is before its end.
            found = [(-r["gain"], 2 * r["code"] + 1, None)] if r["gain"] is not None else []
            found += [(-i["gain"], 2 * i["code"], i) for code in r["codes"] if (i := inside.get((f, code))) and i["gain"] is not None]
            if found:
                splits[f] = min(found, key=lambda s: s[:2])
        gains = np.full((self.n_features, 1), -np.inf)
        for f, (negative, _, _) in splits.items():
            gains[f] = -negative
        feature = int(choose_feature(gains, self.paths, self.growth.features)[0])
        if feature < 0:
            return None
        negative, _, inner = splits[feature]
        if inner:
            return feature, inner["threshold"], inner["left_rows"], -negative
        r = self.known[feature]
        low, high = (inside[feature, r[c]][end] if (feature, r[c]) in inside else float(only[feature][r[c]]) for c, end in (("code", "high"), ("following", "low")))
        return feature, _between(low, high), r["left_rows"], -negative


def grow_tops(rows: DataFrame, n: int, n_features: int, growth: Growth, center: float, target: Target = own_label, cuts: Cuts | None = None) -> list[Top]:
    """Upper parts of all trees, grown until the rows of each leaf fit one task. Each split is the one
    that a task with all rows of the node would find."""
    tops = [Top.start(root_path(t, growth), n) for t in range(growth.trees)]
    cuts = cuts or cut_points(rows, n, n_features, growth)
    if cuts is None:
        return tops
    todo = [(t, 0) for t in range(growth.trees)]
    while todo:
        wanted, todo = todo[:NODES_AT_ONCE], todo[NODES_AT_ONCE:]
        found = _best_cuts(_histograms(rows, tops, wanted, cuts, growth, center, target), cuts, growth).collect()
        by_slot: dict[int, dict[int, dict]] = {}
        for r in found:
            by_slot.setdefault(r["slot"], {})[r["feature"]] = r.asDict()
        nodes: dict[int, _Node] = {}
        asked: Asked = {}
        for slot, known in by_slot.items():
            tree, node = wanted[slot]
            labels = known.pop(n_features, None)
            total, size = np.array(known[0]["total"]), known[0]["rows"]
            top = tops[tree]
            top.rows[node], top.value[node] = size, outcome(total, growth.classes, center)
            pure = is_pure(total, growth.classes) if labels is None else labels["label_low"] >= labels["label_high"]
            if size < max(2, growth.min_split) or pure or growth.max_depth is not None and top.depth[node] >= growth.max_depth:
                top.done[node] = True
            elif size > growth.task_rows:  # else a branch: a task looks at the values themselves
                nodes[slot] = _Node(np.array([top.path[node]], dtype=np.uint64), known, growth, n_features)
                for f, i in nodes[slot].asked():
                    r = known[f]
                    before = np.array(r["before"]).reshape(len(r["codes"]), -1)[i]
                    asked[slot, f, r["codes"][i]] = (r["rows_before"][i], before, size, total)
        inside: dict[int, dict[tuple[int, int], dict]] = {}
        if asked:
            for r in _inside(rows, tops, wanted, cuts, asked, growth, center, target).collect():  # an asked interval each
                inside.setdefault(r["slot"], {})[r["feature"], r["code"]] = r.asDict()
        for slot, n_ in nodes.items():
            tree, node = wanted[slot]
            top, split = tops[tree], n_.best(inside.get(slot, {}), cuts.only)
            if split is None:  # no two values differ
                top.done[node] = True
                continue
            feature, threshold, left, gain = split
            total = np.array(n_.known[0]["total"])
            top.split(node, feature, threshold, (left, top.rows[node] - left), max(0.0, gain - float(score(total, growth.classes))))
            todo += [(tree, child) for child in (top.left[node], top.right[node]) if top.rows[child] > growth.task_rows]
    return tops


# --------------------------------------------------------------------------------------------
# forests


def grow_branches(rows: DataFrame, tops: list[Top], trees: list[int], growth: Growth, center: float, target: Target = own_label) -> DataFrame:
    """Nodes of every branch of the trees, each branch grown in one task."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared.value
        for batch in batches:
            x, marks, weight = matrix(batch["x"]), batch["mark"].to_numpy(), batch["weight"].to_numpy()
            for tree in trees:
                drawn, leaf = draws(marks, tree, growth), tops[tree].route(x)
                mine = np.flatnonzero((drawn > 0) & ~np.array(tops[tree].done)[leaf])
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine), tree, dtype=np.int32)), pa.array(leaf[mine]), batch["mark"].take(take), pa.array(target(batch, tree)[mine]), pa.array(weight[mine] * drawn[mine]), batch["x"].take(take)],
                    names=["tree", "branch", "mark", "label", "weight", "x"],
                )

    def grow(key: tuple, part: pa.Table) -> pa.Table:
        # The order of the rows must not decide between equal splits or the last digit of a sum.
        order = pc.sort_indices(part.select(["mark", "label"]), sort_keys=[("mark", "ascending"), ("label", "ascending")]).to_numpy()
        tree, branch = key[0].as_py(), key[1].as_py()
        top = shared.value[tree]
        found = grow_subtree(in_order(part["x"], order), part["label"].to_numpy()[order], part["weight"].to_numpy()[order], top.path[branch], top.depth[branch], growth, center)
        n = len(found["left"])
        columns = {"tree": np.full(n, tree, dtype=np.int32), "branch": np.full(n, branch, dtype=np.int64), "node": np.arange(n, dtype=np.int32)} | found
        columns["threshold"] = pa.array(found["threshold"], mask=found["left"] < 0)
        width = found["value"].shape[1]
        columns["value"] = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), found["value"].ravel())
        return pa.table([pa.array(columns[c]).cast(k) for c, k in zip(NODE_NAMES, NODE_TYPES)], names=NODE_NAMES)

    dealt = rows.mapInArrow(deal, "tree int, branch bigint, mark bigint, label double, weight double, x array<double>")
    return dealt.groupBy("tree", "branch").applyInArrow(grow, NODE)


def upper_nodes(tops: list[Top]) -> pa.Table:
    """The upper nodes as rows of branch -1; a leaf that is no branch is done there."""
    out = []
    for tree, top in enumerate(tops):
        for i in range(len(top.feature)):
            weight, value = top.value[i] or (0.0, None)
            out.append((tree, -1, i, top.left[i], top.right[i], top.feature[i], float(top.threshold[i]), int(top.rows[i]), weight, value, top.gain[i]))
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*out), NODE_TYPES)], names=NODE_NAMES)


@dataclass
class Forest:
    """A grown forest: ``nodes`` (one row each), its upper parts, and what it was grown with."""

    nodes: DataFrame
    tops: list[Top]
    growth: Growth
    n_features: int

    @property
    def numClasses(self) -> int | None:  # noqa: N802 - as MLlib names it
        return self.growth.classes

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return self.growth.trees

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Mean over trees of each feature's share in the tree's purity gain."""
        by_feature = self.nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        totals = by_feature.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
        shares = by_feature.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
        values = np.zeros(self.n_features)
        for r in shares.collect():  # one row per feature
            values[r["feature"]] = r["share"]
        return DenseVector(values / values.sum() if values.sum() > 0 else values)

    def size_bytes(self) -> int:
        return self.nodes.count() * (48 + 8 * (self.growth.classes or 1))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``probability``: the mean over the trees of
        each leaf's value. Ties go to the smaller class."""
        if self.size_bytes() <= SENT_BYTES:
            out = self._send_forest(df, features)
        else:
            out = self._send_rows(df, features)
        if self.growth.classes is None:
            return out.withColumn("prediction", F.get("__mean", F.lit(0))).drop("__mean")
        best = F.array_position("__mean", F.array_max("__mean")) - 1
        return out.withColumns({"probability": array_to_vector("__mean"), "prediction": best.cast("double")}).drop("__mean")

    def _send_forest(self, df: DataFrame, features: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(Flat.of(self.nodes.toArrow()).sent())

        @F.pandas_udf("array<double>")
        def mean(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.mean(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("__mean", mean(vector_to_array(features)))

    def _send_rows(self, df: DataFrame, features: str) -> DataFrame:
        """Rows go to each tree's branch; branches with many rows are dealt out several times."""
        numbered = written(df.withColumn("__row", F.monotonically_increasing_id()), "to-predict")
        shared = df.sparkSession.sparkContext.broadcast(self.tops)
        trees = self.growth.trees

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                for tree in range(trees):
                    leaf = shared.value[tree].route(x)
                    ended = np.array(shared.value[tree].done)[leaf]
                    columns = [pa.array(np.full(len(x), tree, dtype=np.int32)), pa.array(np.where(ended, -1, leaf)), pa.array(np.where(ended, leaf, 0).astype(np.int32)), *batch.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "branch", "start", "__row", "x"])

        routed = numbered.select("__row", vector_to_array(features).alias("x")).mapInArrow(route, "tree int, branch bigint, start int, __row bigint, x array<double>")
        most = routed.groupBy("tree", "branch").count().agg(F.max("count")).first()[0] or 0
        parts = -(-most // self.growth.task_rows) or 1

        def apply(rows: pa.Table, nodes: pa.Table) -> pa.Table:
            flat = nodes.sort_by("node").combine_chunks()
            cells = [flat[c].to_numpy() for c in ("feature", "threshold", "left", "right")]
            value = node_values(flat["value"])
            rows = rows.combine_chunks()
            leaf = descend(matrix(rows["x"].chunk(0)), rows["start"].to_numpy().astype(np.int64), *cells) if len(rows) else np.zeros(0, dtype=np.int64)
            share = _shares(value[leaf], self_classes)
            cells = pa.ListArray.from_arrays(np.arange(0, share.size + 1, share.shape[1], dtype=np.int32), share.ravel())
            return pa.table([rows["__row"], cells], names=["__row", "value"])

        self_classes = self.growth.classes
        rows = routed.withColumn("part", F.pmod("__row", F.lit(parts)).cast("int"))
        nodes = self.nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        by = ("tree", "branch", "part")
        each = rows.groupBy(*by).cogroup(nodes.groupBy(*by)).applyInArrow(apply, "__row bigint, value array<double>")
        width = self.growth.classes or 1
        means = each.groupBy("__row").agg(F.array(*[F.sum(F.get("value", F.lit(i))) / trees for i in range(width)]).alias("__mean"))
        return numbered.join(means, "__row").drop("__row")

    def node_table(self) -> pd.DataFrame:
        """All nodes in the form in which MLlib saves a forest, one numbering per tree."""
        flat = Flat.of(self.nodes.toArrow())
        rows = []
        for tree, root in enumerate(flat.roots):
            stack = [int(root)]
            while stack:
                i = stack.pop()
                left, right = int(flat.left[i]), int(flat.right[i])
                value = flat.value[i]
                stats = value * flat.weight[i] if self.growth.classes else np.array([flat.weight[i]])
                rows.append((tree, i - int(root), left - int(root) if left >= 0 else -1, right - int(root) if left >= 0 else -1, {"featureIndex": int(flat.feature[i]), "leftCategoriesOrThreshold": [flat.threshold[i]], "numCategories": -1}, stats, float(value[0])))
                if left >= 0:
                    stack += [left, right]
        table = pd.DataFrame(rows, columns=["treeID", "id", "leftChild", "rightChild", "split", "impurityStats", "prediction"])
        return table

    def write(self) -> Forest:
        return self

    def overwrite(self) -> Forest:
        return self

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        settings = json.dumps(asdict(self.growth) | {"n_features": self.n_features})
        spark.createDataFrame([(settings,)], "settings string").write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> Forest:
        spark = SparkSession.getActiveSession()
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        n_features, growth = settings.pop("n_features"), Growth(**settings)
        nodes = spark.read.parquet(f"{path}/nodes")
        upper = nodes.where("branch = -1").orderBy("tree", "node").collect()  # one per task's branch
        grown = {(r["tree"], r["branch"]) for r in nodes.where("branch >= 0").select("tree", "branch").distinct().collect()}
        tops = []
        for tree in range(growth.trees):
            rows = [r for r in upper if r["tree"] == tree]
            lists = [[r[c] for r in rows] for c in ("feature", "threshold", "left", "right")]
            done = [r["left"] < 0 and (tree, r["node"]) not in grown for r in rows]
            blank = [np.uint64(0)] * len(rows)
            tops.append(Top(*lists, blank, [0] * len(rows), [r["rows"] for r in rows], [r["gain"] for r in rows], [(r["weight"], r["value"]) for r in rows], done))
        return cls(nodes, tops, growth, n_features)


def _shares(value: np.ndarray, classes: int | None) -> np.ndarray:
    return value if classes is None else value / np.maximum(value.sum(axis=1, keepdims=True), 1e-300)


@dataclass
class Flat:
    """All nodes of a forest in arrays; children by place, ``roots`` the place of each tree's root."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weight: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Flat:
        table = table.sort_by([("tree", "ascending"), ("branch", "ascending"), ("node", "ascending")]).combine_chunks()
        get = lambda name: table[name].to_numpy(zero_copy_only=False)
        tree, branch, node = get("tree").astype(np.int64), get("branch"), get("node").astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (branch[1:] != branch[:-1])])) if len(tree) else np.zeros(0, dtype=np.int64)
        start = np.repeat(starts, np.diff(np.append(starts, len(tree))))
        left, right = (np.where(get(s) >= 0, start + get(s), -1) for s in ("left", "right"))
        feature, threshold = get("feature").astype(np.int64), np.nan_to_num(get("threshold"))
        value = node_values(table["value"])
        value = _shares(value, value.shape[1] if value.shape[1] > 1 else None)
        first = {(int(tree[i]), int(branch[i])): int(i) for i in starts}
        # An upper leaf that is a branch stands for the branch's root.
        stands = np.arange(len(tree))
        for i in np.flatnonzero((branch < 0) & (left < 0)):
            stands[i] = first.get((int(tree[i]), int(node[i])), i)
        left, right = (np.where(s >= 0, stands[s], -1) for s in (left, right))
        roots = np.array([stands[first[t, -1]] for t in np.unique(tree)], dtype=np.int64)
        return cls(roots, feature, threshold, left, right, get("weight"), value)

    def sent(self) -> Flat:
        """What prediction needs, in two thirds of the bytes: every worker holds a copy."""
        small = {name: getattr(self, name).astype(np.int32) for name in ("feature", "left", "right")}
        return replace(self, weight=np.zeros(0), **small)

    def mean(self, x: np.ndarray) -> np.ndarray:
        """Mean of the leaves' values over the trees."""
        total = np.zeros((len(x), self.value.shape[1]))
        for root in self.roots:
            total += self.value[descend(x, np.full(len(x), root), self.feature, self.threshold, self.left, self.right)]
        return total / len(self.roots)


def grow_forest(rows: DataFrame, key: str, growth: Growth, label: str = "label", weight: str = "weight", features: str = "features") -> Forest:
    """A forest over the rows with a label (class number or value), weight and feature vector.

    Rows without a label are left out. Rows that share a key are drawn equally often. Without rows
    there is nothing to grow: a ValueError. Only the upper parts of the trees, whose number of
    nodes is that of the rows over ``task_rows``, pass through the driver.
    """
    # Sums of single-precision weights of a class are exact in any order: equal splits stay equal.
    heavy = F.col(weight).cast("double") if growth.classes is None else F.col(weight).cast("float").cast("double")
    kept = rows.where(F.col(label).isNotNull()).select(
        F.xxhash64(key).alias("mark"), F.col(label).cast("double").alias("label"), heavy.alias("weight"), vector_to_array(features).alias("x")
    )
    kept = written(kept, "forest-rows")
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("features"), F.avg("label").alias("mean")).first()
    if not size["n"]:
        raise ValueError("no rows to grow a forest from")
    n, n_features = size["n"], size["features"]
    center = size["mean"] if growth.classes is None else 0.0
    tops = grow_tops(kept, n, n_features, growth, center)
    at_once = max(1, PAIRS_AT_ONCE // n)
    path = new_table_path(rows.sparkSession, "forest")
    for begin in range(0, growth.trees, at_once):
        trees = list(range(begin, min(begin + at_once, growth.trees)))
        grow_branches(kept, tops, trees, growth, center).write.mode("append").parquet(path)
    rows.sparkSession.createDataFrame(upper_nodes(tops).to_pylist(), NODE).write.mode("append").parquet(path)
    return Forest(rows.sparkSession.read.schema(NODE).parquet(path), tops, growth, n_features)


@dataclass(frozen=True)
class ForestEstimator:
    """``fit`` like an MLlib estimator. ``features`` is ``sqrt`` or ``all``."""

    key: str
    growth: Growth
    features: str = "sqrt"

    def fit(self, rows: DataFrame) -> Forest:
        n = rows.select(F.size(vector_to_array("features")).alias("n")).first()
        tried = None if self.features == "all" or n is None else max(1, int(np.sqrt(n["n"])))
        return grow_forest(rows, self.key, replace(self.growth, features=tried))
