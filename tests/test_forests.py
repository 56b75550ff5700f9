"""Grown forests beside plain trees."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwise.operators import explain, forests, prepare
from panelwise.operators.forests import Flat, Forest, Growth, ForestEstimator, grow_forest, grow_subtree, in_order, root_path

ALONE = dict(trees=1, bootstrap=False)


def purity(y, w, classes):
    """Weighted impurity, summed over the rows."""
    if not len(y):
        return 0.0
    if classes is None:
        mean = np.average(y, weights=w)
        return float((w * (y - mean) ** 2).sum())
    share = np.bincount(y.astype(int), weights=w, minlength=classes)
    return float(share.sum() - (share**2).sum() / share.sum())


def best_split(x, y, w, growth):
    """Least impurity after any split of any feature, by trying all."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            if min(left.sum(), (~left).sum()) < growth.min_leaf:
                continue
            rest = purity(y[left], w[left], growth.classes) + purity(y[~left], w[~left], growth.classes)
            if best is None or rest < best[0] - 1e-9:
                best = (rest, f, (low + high) / 2)
    return best


def check_tree(nodes, x, y, w, growth, at=0, depth=0):
    """Every node has the rows it should, splits as well as any split does, and ends where it must."""
    n = nodes[at]
    assert n["rows"] == len(y) and n["weight"] == pytest.approx(w.sum())
    if growth.classes is None:
        assert n["value"][0] == pytest.approx(np.average(y, weights=w))
    else:
        assert n["value"] == pytest.approx(np.bincount(y.astype(int), weights=w, minlength=growth.classes))
    may = len(y) >= max(2, growth.min_split) and len(set(y)) > 1 and (growth.max_depth is None or depth < growth.max_depth)
    best = best_split(x, y, w, growth) if may else None
    assert (n["left"] >= 0) == (best is not None)
    if best is None:
        return depth
    left = x[:, n["feature"]] <= n["threshold"]
    own = purity(y[left], w[left], growth.classes) + purity(y[~left], w[~left], growth.classes)
    assert own == pytest.approx(best[0], abs=1e-7)
    assert n["gain"] == pytest.approx(purity(y, w, growth.classes) - own, abs=1e-7)
    values = np.unique(x[:, n["feature"]])
    assert any(n["threshold"] == pytest.approx((a + b) / 2) for a, b in zip(values, values[1:]))
    return max(check_tree(nodes, x[s], y[s], w[s], growth, n[c], depth + 1) for s, c in ((left, "left"), (~left, "right")))


def listed(columns):
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


@pytest.mark.parametrize("classes", [None, 2, 3])
@pytest.mark.parametrize("limits", [{}, {"max_depth": 3}, {"min_leaf": 4}, {"min_split": 9}])
def test_subtree_is_the_exact_tree(classes, limits):
    r = np.random.default_rng(4)
    for kind in range(4):
        n = 60
        x = np.stack([r.integers(0, 5, n), r.normal(size=n), np.full(n, 2.0)], axis=1).astype(float)
        y = r.normal(size=n).round(1) if classes is None else r.integers(0, classes, n).astype(float)
        if kind == 3:  # rows that no feature tells apart
            x[:] = x[:5].repeat(12, axis=0)
        w = r.integers(1, 4, n).astype(float) if kind else np.ones(n)
        growth = Growth(classes, **ALONE, **limits)
        found = grow_subtree(x, y, w, root_path(0, growth), 0, growth)
        check_tree(listed(found), x, y, w, growth)


def test_memory_of_a_subtree():
    """Beside its matrix a task holds the order of the rows by each feature, in 4 bytes a row, and
    the nodes as arrays."""
    r = np.random.default_rng(0)
    x, y = r.normal(size=(10_000, 64)), r.integers(0, 3, 10_000).astype(float)
    tracemalloc.start()
    try:
        grow_subtree(x, y, np.ones(len(y)), root_path(0, Growth(3)), 0, Growth(3, features=8))
        assert tracemalloc.get_traced_memory()[1] < 1.25 * x.nbytes
    finally:
        tracemalloc.stop()


def test_vectors_in_order():
    x = np.random.default_rng(1).normal(size=(7, 3))
    order = np.array([6, 0, 3, 1, 5, 2, 4])
    column = pa.chunked_array([pa.array(list(x[a:b]), pa.list_(pa.float64())) for a, b in ((0, 2), (2, 2), (2, 7))])
    assert np.array_equal(in_order(column, order), x[order])


def test_no_limit_of_depth():
    """A chain: each split takes one row off, 200 levels deep."""
    n = 200
    x = np.arange(n, dtype=float)[:, None]
    growth = Growth(None, **ALONE)
    found = grow_subtree(x, np.cumsum(np.arange(n) ** 3.0), np.ones(n), root_path(0, growth), 0, growth)
    assert sum(v < 0 for v in found["left"]) == n
    nodes = listed(grow_subtree(x, 2.0 ** np.arange(n), np.ones(n), root_path(0, growth), 0, growth))
    depth = lambda i: 0 if nodes[i]["left"] < 0 else 1 + max(depth(nodes[i]["left"]), depth(nodes[i]["right"]))
    assert depth(0) > 30


def frame(spark, x, y, weight=None):
    rows = [(i, float(b), float(weight[i]) if weight is not None else 1.0, *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, "id bigint, label double, weight double, " + ", ".join(f"{c} double" for c in names))
    return prepare.assemble(df.repartition(3), names)


@pytest.fixture(scope="module")
def sample():
    r = np.random.default_rng(8)
    x = np.stack([r.integers(0, 40, 600), r.normal(size=600).round(2), r.normal(size=600).round(2)], axis=1).astype(float)
    return x, ((x[:, 0] > 20) ^ (x[:, 1] > 0)).astype(float), np.round(x[:, 0] * 3 + x[:, 2], 3)


@pytest.mark.parametrize("classes", [None, 2])
def test_one_task_or_many(spark, sample, classes):
    """A table over the limit of a task is split at cut points first; where these tell all values
    apart the tree fits the rows as well, to the last one."""
    x, y, z = sample
    target = z if classes is None else y
    df = frame(spark, x, target)
    exact = grow_forest(df, "id", Growth(classes, **ALONE))
    assert exact.nodes.where("branch = -1").count() == 1
    nodes = [r.asDict() for r in exact.nodes.where("branch = 0").orderBy("node").collect()]
    check_tree(nodes, x, target, np.ones(len(x)), exact.growth)
    cut = grow_forest(df, "id", Growth(classes, **ALONE, task_rows=80))
    upper = cut.nodes.where("branch = -1")
    assert upper.count() > 5 and cut.nodes.where("branch >= 0 and node = 0").agg(F.max("rows")).first()[0] <= 80
    assert upper.where("node = 0").first()["rows"] == len(x)
    for forest in (exact, cut):
        got = forest.transform(df).select("label", "prediction").collect()
        assert all(r["prediction"] == pytest.approx(r["label"], abs=1e-9) for r in got)


def test_rows_sent_to_the_trees(spark, sample, monkeypatch):
    """Both ways to predict give the same, also for upper leaves that no task grew on."""
    x, y, z = sample
    for target, classes in ((y, 2), (z, None), (np.where(x[:, 0] > 20, 1.0, 0.0), 2)):
        df = frame(spark, x, target)
        forest = grow_forest(df, "id", Growth(classes, trees=5, task_rows=100, features=2))
        sent = {r["id"]: r for r in forest.transform(df).collect()}
        monkeypatch.setattr("panelwise.operators.forests.SENT_BYTES", 0)
        routed = forest.transform(df).collect()
        monkeypatch.undo()
        assert len(routed) == len(sent) == len(x)
        assert all(r["prediction"] == pytest.approx(sent[r["id"]]["prediction"]) for r in routed)
        assert {c for c in routed[0].asDict()} == {c for c in sent[0].asDict()}


def test_reruns_agree_whatever_the_partitions(spark, sample):
    x, y, _ = sample
    df = frame(spark, x, y)
    growth = Growth(2, trees=4, features=1, min_leaf=3)
    first, again = (sorted(map(str, grow_forest(d, "id", growth).nodes.collect())) for d in (df, df.repartition(7)))
    assert first == again
    other = grow_forest(df, "id", Growth(2, trees=4, features=1, min_leaf=3, seed=1))
    assert sorted(map(str, other.nodes.collect())) != first


def test_forest_scores_importance_and_disk(spark, sample, tmp_path):
    x, y, _ = sample
    df = frame(spark, x, y)
    forest = ForestEstimator("id", Growth(2, trees=20)).fit(df)
    assert forest.growth.features == 1
    weights = forest.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1.0) and weights[2] < min(weights[0], weights[1])
    out = forest.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.97
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in out)
    forest.write().overwrite().save(str(tmp_path))
    loaded = Forest.load(str(tmp_path))
    assert loaded.growth == forest.growth
    assert sorted(map(str, loaded.transform(df).select("id", "probability").collect())) == sorted(map(str, forest.transform(df).select("id", "probability").collect()))


def test_attributions_add_up(spark, sample):
    x, y, z = sample
    for target, classes in ((y, 2), (z, None)):
        df = frame(spark, x[:80], target[:80])
        forest = grow_forest(df, "id", Growth(classes, trees=3))
        phi, base = explain.tree_attribution(df, "id", "features", forest, ["a", "b", "c"])
        last = phi.where(F.col("class_index") == len(base) - 1).groupBy("id").agg(F.sum("phi").alias("phi"))
        out = forest.transform(df).select("id", (F.get(vector_to_array("probability"), F.lit(1)) if classes else F.col("prediction")).alias("out"))
        gap = last.join(out, "id").select(F.max(F.abs(F.col("phi") + base[-1] - F.col("out")))).first()[0]
        assert gap < 1e-9


def test_edges(spark):
    """No rows, one row, one class, labels that are missing, equal rows."""
    empty = frame(spark, np.zeros((1, 2)), [0.0]).where("id < 0")
    with pytest.raises(ValueError, match="no rows"):
        grow_forest(empty, "id", Growth(2, trees=2))
    one = frame(spark, np.zeros((1, 2)), [1.0])
    assert grow_forest(one, "id", Growth(2, **ALONE)).transform(one).first()["prediction"] == 1.0
    same = frame(spark, np.ones((30, 2)), [0.0] * 20 + [1.0] * 10)
    forest = grow_forest(same, "id", Growth(2, **ALONE, task_rows=10))
    assert forest.nodes.where("left >= 0").count() == 0
    assert forest.transform(same).first()["prediction"] == 0.0
    missing = same.withColumn("label", F.when(F.col("id") >= 20, F.col("label")))
    assert grow_forest(missing, "id", Growth(2, **ALONE)).transform(same).first()["prediction"] == 1.0
    flat = Flat.of(forest.nodes.toArrow())
    assert np.allclose(flat.mean(np.ones((2, 2))), [[2 / 3, 1 / 3]] * 2)


def test_gains_of_tried_features_only(monkeypatch):
    """A root that looks at one of eight features computes the gains of its 399 split points only."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=(400, 8)), r.integers(0, 2, 400).astype(float)
    real, scored = forests.score, []
    monkeypatch.setattr(forests, "score", lambda sums, classes: scored.append(len(sums)) or real(sums, classes))
    grown = forests.grow_subtree(x, y, np.ones(400), np.uint64(1), 0, forests.Growth(2, max_depth=1, features=1))
    assert len(grown["left"]) == 3
    assert sum(scored) <= 2 * 399 + 1


def test_few_and_many_intervals(spark, monkeypatch):
    """Histograms held as a table of all cells, and as pairs, give the same upper nodes."""
    r = np.random.default_rng(4)
    cells = [(i, float(a > 0.2), 1.0 + i % 2, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(500, 2)).round(2))]
    df = prepare.assemble(spark.createDataFrame(cells, "id bigint, label double, weight double, a double, b double").repartition(3), ["a", "b"])
    growth = forests.Growth(2, trees=4, features=1, task_rows=60)
    few = forests.grow_forest(df, "id", growth).tops
    monkeypatch.setattr(forests, "HELD_CELLS", 1)
    many = forests.grow_forest(df, "id", growth).tops
    for a, b in zip(few, many):
        assert (a.feature, a.threshold, a.left, a.rows) == (b.feature, b.threshold, b.left, b.rows)
    assert any(len(t.feature) > 3 for t in few)


def splits(forest):
    """Every tree as nested tuples: feature, threshold, rows and both sides, or the rows of a leaf."""
    flat = Flat.of(forest.nodes.toArrow())

    def below(i):
        if flat.left[i] < 0:
            return tuple(flat.value[i].round(9))
        return int(flat.feature[i]), float(flat.threshold[i]), below(flat.left[i]), below(flat.right[i])

    return [below(root) for root in flat.roots]


@pytest.mark.parametrize(("classes", "limits"), [(None, {"features": 2}), (2, {"features": 1, "min_leaf": 3}), (3, {"max_depth": 4, "min_leaf": 40})])
def test_splits_do_not_depend_on_size(spark, monkeypatch, classes, limits):
    """Values that cut points do not tell apart: a table over the limit of a task grows the same trees."""
    monkeypatch.setattr(forests, "FEW_CUTS", 7)
    r = np.random.default_rng(11)
    x = np.stack([r.normal(size=512), r.integers(0, 9, 512), np.exp(r.normal(size=512)), np.where(r.random(512) < 0.98, 1.0, r.random(512))], axis=1)
    part = (x[:, 0] > 0.3).astype(int) + (x[:, 2] > 1.1) * (x[:, 1] > 3) + (r.random(512) < 0.2)
    label = part * 8.0 + r.integers(0, 3, 512) if classes is None else part % classes
    df = frame(spark, x, label, r.integers(1, 4, 512) if classes is None else np.array([0.7, 1 / 3, 2.2])[label.astype(int)])
    growth = dict(trees=3, **limits)
    whole = grow_forest(df, "id", Growth(classes, **growth))
    cut = grow_forest(df, "id", Growth(classes, task_rows=90, **growth))
    assert sum(len(t.feature) for t in cut.tops) > sum(len(t.feature) for t in whole.tops) == 3
    assert splits(cut) == splits(whole)
    monkeypatch.setattr(forests, "HELD_CELLS", 1)
    assert splits(grow_forest(df, "id", Growth(classes, task_rows=90, **growth))) == splits(whole)


@pytest.mark.parametrize("classes", [None, 2, 5])
def test_bound_of_an_interval(classes):
    """No order of an interval's rows has a split that gains more than the bound, which is tight
    enough to leave out most intervals."""
    r = np.random.default_rng(2)
    left_out = 0
    for _ in range(60):
        y = r.normal(size=400) if classes is None else r.integers(0, classes, 400).astype(float)
        y = np.sort(y) if r.random() < 0.5 else y
        sums = forests.row_sums(y, r.integers(1, 4, 400).astype(float), classes)
        total, ends = sums.sum(axis=0), np.arange(0, 401, 20)
        known = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])[ends]
        bound = forests.most_inside(known[:-1], known[1:], total, classes)
        best = max(forests.score(known[1:-1], classes) + forests.score(total - known[1:-1], classes))
        left_out += (bound < best).sum()
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            for order in (r.permutation(20), np.argsort(y[a:b]), np.argsort(-y[a:b])):
                left = known[i] + np.cumsum(sums[a:b][order], axis=0)[:-1]
                assert (forests.score(left, classes) + forests.score(total - left, classes) <= bound[i] * (1 + 1e-9)).all()
    assert left_out > 300


def test_many_equal_values_and_none_apart(spark):
    """A node over the limit whose values are all equal ends; one other value is found among many."""
    x = np.ones((90, 2))
    x[7, 1] = 1.5
    y = np.zeros(90)
    y[[7, 8]] = 1.0
    forest = grow_forest(frame(spark, x, y), "id", Growth(2, **ALONE, task_rows=10))
    top = forest.tops[0]
    assert (top.feature, top.threshold[0], top.rows, top.done[1]) == ([1, -1, -1], 1.25, [90, 89, 1], True)


def test_node_values_without_lists():
    column = pa.chunked_array([pa.array([[1.0, 2.0], None], pa.list_(pa.float64())), pa.array([[], [3.0, 4.0]], pa.list_(pa.float64()))])
    assert forests.node_values(column).tolist() == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0], [3.0, 4.0]]
    assert forests.node_values(column.slice(1, 2)).tolist() == [[0.0], [0.0]]
