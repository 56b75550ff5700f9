"""Networks: gradients beside finite differences, steps beside plain Python, reruns."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwise.operators import networks, prepare
from panelwise.operators.networks import Network, NetworkEstimator, NetworkSettings, State, first_weights, gradients, outputs


@pytest.mark.parametrize("classes", [None, 3])
def test_gradients_are_finite_differences(classes):
    r = np.random.default_rng(2)
    s = NetworkSettings(classes, hidden=(5, 4))
    layers = first_weights(3, s)
    for layer in layers:
        for n in layer:
            layer[n] = layer[n] + 0.1 * r.normal(size=layer[n].shape)
    x = r.normal(size=(7, 3))
    y = r.normal(size=7) if classes is None else r.integers(0, classes, 7).astype(float)
    masks = [(r.random((7, n)) >= 0.3) / 0.7 for n in s.hidden]
    _, grads, _ = gradients(layers, x, y, s, masks)
    for i, layer in enumerate(layers):
        for n in networks._names(layer):
            for at in np.ndindex(layer[n].shape):
                old, ends = layer[n][at], []
                for move in (1e-6, -1e-6):
                    layer[n][at] = old + move
                    ends.append(gradients(layers, x, y, s, masks)[0])
                layer[n][at] = old
                assert grads[i][n][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=2e-4)


def test_state_is_packed_and_unpacked():
    s = NetworkSettings(2, hidden=(4, 3))
    state = State.start(first_weights(2, s))
    r = np.random.default_rng(0)
    _, grads, seen = gradients(state.layers, r.normal(size=(6, 2)), r.integers(0, 2, 6).astype(float), s, [np.ones((6, 4)), np.ones((6, 3))])
    state.step(grads, seen, 0.01)
    again = State.start(first_weights(2, s)).unpacked(state.packed())
    assert again.steps == 1
    for a, b in zip(state.layers, again.layers):
        assert all(np.array_equal(a[n], b[n]) for n in a)
    assert all(np.array_equal(a[n], b[n]) for a, b in zip(state.second, again.second) for n in a)


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 2))
    y = ((x[:, 0] * x[:, 1] > 0) + 2 * (x[:, 0] > 1)) % 3
    rows = [(i, float(c), *map(float, a)) for i, (c, a) in enumerate(zip(y, x))]
    return x, y.astype(float), prepare.assemble(spark.createDataFrame(rows, "id bigint, label double, a double, b double").repartition(3), ["a", "b"])


def test_one_step_over_two_tasks(spark, table):
    """One batch with all rows: the exchanged gradient is that of plain Python over both parts."""
    x, y, df = table
    s = NetworkSettings(3, hidden=(6,), dropout=0.0, batch=1000, epochs=1, held_back=0.0, task_rows=200)
    model = NetworkEstimator("id", s).fit(df)
    rows = df.select(F.xxhash64("id", F.lit(s.seed)).alias("mark"), "id")
    mixed = F.xxhash64("mark", F.lit(s.seed * 100_003))
    part = {r["id"]: r["p"] for r in rows.withColumn("o", mixed).repartition(2, "o").select("id", F.spark_partition_id().alias("p")).collect()}
    state = State.start(first_weights(2, s))
    total, means = None, None
    for p in (0, 1):
        mine = np.array([part[i] == p for i in range(len(y))])
        _, grads, seen = gradients(state.layers, x[mine], y[mine], s, [np.ones((mine.sum(), 6))])
        flat, weighted = networks._flat(grads), networks._flat(seen) * mine.sum()
        total, means = (flat, weighted) if total is None else (total + flat, means + weighted)
    state.step(networks._unflat(total / len(y), grads), networks._unflat(means / len(y), seen), s.rate)
    for a, b in zip(state.layers, model.layers):
        assert all(np.allclose(a[n], b[n], atol=1e-12) for n in a)


def test_learns_stops_and_agrees(spark, table, tmp_path):
    x, y, df = table
    s = NetworkSettings(3, hidden=(32, 16), rate=0.01, dropout=0.1, batch=8, epochs=14, patience=4)
    model = NetworkEstimator("id", s).fit(df)
    again = NetworkEstimator("id", s).fit(df.repartition(5))
    assert model.history == again.history
    assert model.history[-1][0] < 0.75 * model.history[0][0]
    held = [h for _, h, _ in model.history]
    last = len(held) if len(held) == s.epochs else len(held) - s.patience
    assert min(held) == min(held[:last])
    out = model.transform(df).select("id", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.75
    expected = outputs(model.layers, x, 3)
    assert all(np.allclose(r["p"], expected[r["id"]]) for r in out)
    model.write().overwrite().save(str(tmp_path))
    loaded = Network.load(str(tmp_path))
    assert loaded.settings == model.settings and np.array_equal(outputs(loaded.layers, x, 3), expected)


def test_more_rows_more_tasks():
    s = NetworkSettings(2, task_rows=100, most_steps=10, most_tasks=8)
    assert s.sized(100, 16) == (1, s)
    tasks, large = s.sized(2560, 6)
    assert tasks == 6 and large.batch == 256 and large.rate == pytest.approx(2 * s.rate)


def test_several_tasks_agree_and_learn(table):
    x, y, df = table
    s = NetworkSettings(3, hidden=(16,), rate=0.02, dropout=0.1, batch=120, epochs=3, task_rows=150)
    model = NetworkEstimator("id", s).fit(df)
    assert model.history == NetworkEstimator("id", s).fit(df.repartition(5)).history
    assert model.history[-1][0] < model.history[0][0]


def test_early_stop_and_slower_steps(table, monkeypatch):
    """A held-back loss that only rises: the first weights stay, the rate is halved, training ends."""
    _, _, df = table
    rising = iter(range(1, 100))
    monkeypatch.setattr(networks, "_held_loss", lambda *_: float(next(rising)))
    s = NetworkSettings(3, hidden=(4,), batch=300, epochs=20, patience=5, slower_after=2)
    model = NetworkEstimator("id", s).fit(df)
    assert [h for _, h, _ in model.history] == [1, 2, 3, 4, 5, 6]
    assert [r for _, _, r in model.history] == [0.001, 0.001, 0.001, 0.0005, 0.0005, 0.00025]


def test_regression_and_edges(spark, table):
    x, _, df = table
    line = df.withColumn("label", F.get(vector_to_array("features"), F.lit(0)) * 2)
    model = NetworkEstimator("id", NetworkSettings(None, hidden=(16,), rate=0.02, dropout=0.0, batch=8, epochs=8)).fit(line)
    gap = model.transform(line).select(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert gap < 1.0
    with pytest.raises(ValueError, match="no rows"):
        NetworkEstimator("id", NetworkSettings(2)).fit(df.where("id < 0"))
    one = NetworkEstimator("id", NetworkSettings(2, hidden=(3,), epochs=1)).fit(df.where("label < 2").limit(1))
    assert one.transform(df).count() == len(x)


def test_many_steps_take_no_second_each(table):
    """Some 30 exchanges of gradients; Spark's own exchange would take a second for each."""
    _, _, df = table
    s = NetworkSettings(3, hidden=(4,), batch=8, epochs=1, task_rows=150, most_steps=50)
    NetworkEstimator("id", replace(s, batch=1000)).fit(df)
    begin = time.monotonic()
    model = NetworkEstimator("id", s).fit(df)
    assert model.history[0][0] > 0
    assert time.monotonic() - begin < 15


def test_messages_are_added_in_the_order_of_tasks(tmp_path):
    """Tasks that run at their own pace all get the same sums; files that all have read are deleted."""
    tasks, steps = 3, 20
    meet, asked, values = Barrier(tasks), [], np.random.default_rng(1).normal(size=(steps, tasks, 5))

    class Context:
        def __init__(self, task):
            self.task = task

        def partitionId(self):  # noqa: N802
            return self.task

        def taskAttemptId(self):  # noqa: N802
            return 10 + self.task

        def allGather(self, message):  # noqa: N802
            asked.append(message)
            meet.wait()
            return ["10", "11", "12"]

    def work(task):
        exchange = networks._Exchange(Context(task), f"file://{tmp_path}/steps")
        sums = []
        for step in range(steps):
            time.sleep(0.002 * ((task + step) % 3))
            sums.append(exchange.total(values[step, task]))
        return np.array(sums)

    with ThreadPoolExecutor(tasks) as pool:
        found = list(pool.map(work, range(tasks)))
    expected = values[:, 0] + values[:, 1] + values[:, 2]
    assert all(np.array_equal(f, expected) for f in found)
    assert len(asked) == tasks
    assert len(list((tmp_path / "steps").iterdir())) <= tasks
