"""Boosting for several classes beside plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from panelwise.operators import prepare
from panelwise.operators.boosting import BoostedClasses, Boosting, BoostingEstimator, shares


def plain_tree(x, y, depth):
    """A regression tree by trying every split: (feature, threshold, left, right) or row numbers."""

    def grow(rows, depth):
        best = None
        if depth and len(rows) > 1 and np.ptp(y[rows]) > 0:
            total = ((y[rows] - y[rows].mean()) ** 2).sum()
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for low, high in zip(values, values[1:]):
                    left, right = rows[x[rows, f] <= low], rows[x[rows, f] > low]
                    rest = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, right))
                    if best is None or rest < best[0]:
                        best = (rest, f, (low + high) / 2, left, right)
            assert best is None or best[0] <= total + 1e-9
        if best is None:
            return rows
        return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)

    return grow(np.arange(len(x)), depth)


def leaf_sets(tree):
    return [tree] if isinstance(tree, np.ndarray) else leaf_sets(tree[2]) + leaf_sets(tree[3])


def plain_boosting(x, y, classes, rounds, depth, rate):
    scores = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))
    losses = []
    for _ in range(rounds):
        p = shares(scores)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        for k in range(classes):
            r = (y == k) - p[:, k]
            for rows in leaf_sets(plain_tree(x, r, depth)):
                step = (classes - 1) / classes * r[rows].sum() / (np.abs(r[rows]) * (1 - np.abs(r[rows]))).sum()
                scores[rows, k] += rate * step
    return scores, losses


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 3))
    y = (np.digitize(x[:, 0] + 0.3 * r.normal(size=150), [-0.5, 0.5]) + (x[:, 1] > 1.2)) % 3
    df = spark.createDataFrame([(i, float(c), *map(float, row)) for i, (c, row) in enumerate(zip(y, x))], "id bigint, label double, a double, b double, c double")
    return x, y.astype(int), prepare.assemble(df.repartition(3), ["a", "b", "c"])


def test_equals_plain_boosting(table, monkeypatch):
    """Scores stored in between or not, the same as plain Python to the eighth digit."""
    x, y, df = table
    monkeypatch.setattr("panelwise.operators.boosting.STORE_ROUNDS", 2)
    model = BoostingEstimator("id", Boosting(3, rounds=5, max_depth=3)).fit(df)
    scores, losses = plain_boosting(x, y, 3, 5, 3, 0.1)
    assert np.allclose(model.scores(x), scores, atol=1e-7)
    assert np.allclose(model.losses[:-1], losses, atol=1e-7)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    out = {r["id"]: r for r in model.transform(df).select("id", "prediction", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("s")).collect()}
    for i in range(len(x)):
        assert np.allclose(out[i]["s"], scores[i], atol=1e-7) and np.allclose(out[i]["p"], shares(scores[i : i + 1])[0], atol=1e-7)
        assert out[i]["prediction"] == scores[i].argmax()


def test_many_tasks_per_tree(table):
    """Trees whose upper splits come from histograms: the loss falls as well."""
    x, y, df = table
    model = BoostingEstimator("id", Boosting(3, rounds=3, max_depth=3, task_rows=40)).fit(df)
    exact = BoostingEstimator("id", Boosting(3, rounds=3, max_depth=3)).fit(df)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert abs(model.losses[-1] - exact.losses[-1]) < 0.05


def test_importance_and_disk(spark, table, tmp_path):
    x, y, df = table
    model = BoostingEstimator("id", Boosting(3, rounds=2, max_depth=2)).fit(df)
    weights = model.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1.0) and weights.argmax() == 0 and weights[2] < 0.2
    model.write().overwrite().save(str(tmp_path))
    loaded = BoostedClasses.load(str(tmp_path))
    assert loaded.settings == model.settings and np.array_equal(loaded.scores(x), model.scores(x))


def test_edges(table):
    """A class without rows, one class only, no rows at all, missing labels."""
    x, y, df = table
    model = BoostingEstimator("id", Boosting(4, rounds=1, max_depth=2)).fit(df)
    assert set(r["prediction"] for r in model.transform(df).collect()) <= {0.0, 1.0, 2.0}
    one = df.where("label = 1")
    assert {r["prediction"] for r in BoostingEstimator("id", Boosting(3, rounds=1)).fit(one).transform(df).collect()} == {1.0}
    with pytest.raises(ValueError, match="no rows"):
        BoostingEstimator("id", Boosting(3, rounds=1)).fit(df.where("label > 5"))
    from pyspark.sql import functions as F

    part = df.withColumn("label", F.when(F.col("id") < 100, F.col("label")))
    few = BoostingEstimator("id", Boosting(3, rounds=1)).fit(part)
    assert np.allclose(few.scores(x), BoostingEstimator("id", Boosting(3, rounds=1)).fit(df.where("id < 100")).scores(x))
