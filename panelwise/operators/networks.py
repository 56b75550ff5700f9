"""Networks with batch normalisation and dropout, trained by synchronous minibatches.

An epoch is one stage whose tasks stream the rows, dealt and ordered anew by a hash and sorted
outside of memory. Up to ``task_rows`` rows go to one task. More rows go to several tasks of a
barrier stage, which run at the same time and exchange their gradients after every minibatch, so
that all hold the same weights: as files in the shared folder, since Spark's own exchange takes a
second, whatever is sent. Such an epoch has at most ``most_steps`` minibatches, which grow with the
rows, as does the learning rate with the root of their size.

Then the loss on the rows kept back is measured by a plain job, and the driver decides about the
learning rate and the end. What passes through the driver are weights; their number follows from the
layers, not from the rows. A lost executor costs an epoch: the stage starts anew from the weights
before it.
"""

from __future__ import annotations

import base64
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.session import new_table_path
from panelwise.sources.folders import arrow_store, remove

# Of batch normalisation and of the Adam steps.
KEPT_MEAN, NORM_EPSILON = 0.99, 1e-3
FIRST_MOMENT, SECOND_MOMENT, STEP_EPSILON = 0.9, 0.999, 1e-7
#: A task waits so long for another one's message.
WAIT_SECONDS = 3600


@dataclass(frozen=True)
class NetworkSettings:
    """``classes`` None is a regression. ``batch`` rows go into a step, over all tasks."""

    classes: int | None
    hidden: tuple[int, ...] = (256, 128, 64)
    dropout: float = 0.3
    rate: float = 0.001
    batch: int = 64
    epochs: int = 50
    held_back: float = 0.2
    patience: int = 5
    slower_after: int = 3
    slower_by: float = 0.5
    least_rate: float = 1e-6
    task_rows: int = 200_000
    most_tasks: int = 64
    most_steps: int = 200
    seed: int = 42

    def sized(self, rows: int, slots: int) -> tuple[int, NetworkSettings]:
        """Tasks for so many rows, and the settings with the batch and rate for them."""
        tasks = max(1, min(-(-rows // self.task_rows), self.most_tasks, slots))
        if tasks == 1:
            return 1, self
        batch = max(self.batch, -(-rows // self.most_steps))
        return tasks, replace(self, batch=batch, rate=self.rate * float(np.sqrt(batch / self.batch)))


Weights = list[dict[str, np.ndarray]]


def first_weights(n_features: int, s: NetworkSettings) -> Weights:
    """Uniform in the range of Glorot and Bengio; the last layer has no normalisation."""
    r = np.random.default_rng(s.seed)
    sizes = [n_features, *s.hidden, s.classes or 1]
    layers = []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        limit = np.sqrt(6 / (a + b))
        layer = {"w": r.uniform(-limit, limit, (a, b)), "b": np.zeros(b)}
        if i < len(s.hidden):
            layer |= {"scale": np.ones(b), "shift": np.zeros(b), "mean": np.zeros(b), "var": np.ones(b)}
        layers.append(layer)
    return layers


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def outputs(layers: Weights, x: np.ndarray, classes: int | None) -> np.ndarray:
    """Class shares or values of rows, with the running means and variances."""
    for layer in layers[:-1]:
        x = np.maximum(0.0, x @ layer["w"] + layer["b"])
        x = (x - layer["mean"]) / np.sqrt(layer["var"] + NORM_EPSILON) * layer["scale"] + layer["shift"]
    x = x @ layers[-1]["w"] + layers[-1]["b"]
    return x if classes is None else _softmax(x)


def row_losses(out: np.ndarray, y: np.ndarray, classes: int | None) -> np.ndarray:
    """Cross entropy, or squared error, of each row."""
    if classes is None:
        return (out[:, 0] - y) ** 2
    return -np.log(np.maximum(out[np.arange(len(y)), y.astype(int)], 1e-7))


def gradients(layers: Weights, x: np.ndarray, y: np.ndarray, s: NetworkSettings, masks: list[np.ndarray]) -> tuple[float, Weights, Weights]:
    """Summed loss of a batch, its gradient, and the batch's means and variances by layer."""
    kept, seen = [], []
    a = x
    # Arrays are changed in place where they can be: most of the time goes to those of a row and unit.
    for layer, mask in zip(layers, masks):
        h = a @ layer["w"]
        h += layer["b"]
        active = h > 0
        np.maximum(0.0, h, out=h)
        mean = h.mean(axis=0)
        h -= mean
        var = (h * h).mean(axis=0)
        root = np.sqrt(var + NORM_EPSILON)
        h /= root
        kept.append((a, active, h, root))
        seen.append({"mean": mean, "var": var})
        a = h * layer["scale"]
        a += layer["shift"]
        a *= mask
    out = a @ layers[-1]["w"] + layers[-1]["b"]
    if s.classes is None:
        loss = float(row_losses(out, y, None).sum())
        back = 2 * (out - y[:, None])
    else:
        p = _softmax(out)
        loss = float(row_losses(p, y, s.classes).sum())
        back = p.copy()
        back[np.arange(len(y)), y.astype(int)] -= 1
    grads: Weights = [{"w": a.T @ back, "b": back.sum(axis=0)}]
    back = back @ layers[-1]["w"].T
    for i, (layer, mask, (a, active, unit, root)) in enumerate(zip(reversed(layers[:-1]), reversed(masks), reversed(kept)), 2):
        back *= mask
        part = back * unit
        grad = {"scale": part.sum(axis=0), "shift": back.sum(axis=0)}
        back *= layer["scale"]
        np.multiply(back, unit, out=part)
        np.multiply(unit, part.mean(axis=0), out=part)
        back -= back.mean(axis=0)
        back -= part
        back /= root
        back *= active
        grads.insert(0, grad | {"w": a.T @ back, "b": back.sum(axis=0)})
        if i < len(layers):  # nothing is learnt below the first layer
            back = back @ layer["w"].T
    return loss, grads, seen


def _names(layer: dict[str, np.ndarray]) -> list[str]:
    return [n for n in ("w", "b", "scale", "shift") if n in layer]


def _flat(layers: Weights) -> np.ndarray:
    return np.concatenate([layer[n].ravel() for layer in layers for n in sorted(layer)] or [np.zeros(0)])


def _unflat(values: np.ndarray, like: Weights) -> Weights:
    out, at = [], 0
    for layer in like:
        new = {}
        for n in sorted(layer):
            size = layer[n].size
            new[n] = values[at : at + size].reshape(layer[n].shape)
            at += size
        out.append(new)
    return out


@dataclass
class State:
    """Weights, their moments, and the steps taken."""

    layers: Weights
    first: Weights
    second: Weights
    steps: int

    @classmethod
    def start(cls, layers: Weights) -> State:
        zeros = [{n: np.zeros_like(layer[n]) for n in _names(layer)} for layer in layers]
        return cls(layers, zeros, [{n: v.copy() for n, v in z.items()} for z in zeros], 0)

    def step(self, grads: Weights, seen: Weights, rate: float) -> None:
        """One Adam step; running means and variances move towards the batch's."""
        self.steps += 1
        fix = np.sqrt(1 - SECOND_MOMENT**self.steps) / (1 - FIRST_MOMENT**self.steps)
        for layer, m, v, g in zip(self.layers, self.first, self.second, grads):
            for n in _names(layer):
                m[n] = FIRST_MOMENT * m[n] + (1 - FIRST_MOMENT) * g[n]
                v[n] = SECOND_MOMENT * v[n] + (1 - SECOND_MOMENT) * g[n] ** 2
                layer[n] = layer[n] - rate * fix * m[n] / (np.sqrt(v[n]) + STEP_EPSILON)
        for layer, batch in zip(self.layers, seen):
            for n in ("mean", "var"):
                layer[n] = KEPT_MEAN * layer[n] + (1 - KEPT_MEAN) * batch[n]

    def packed(self) -> bytes:
        return np.concatenate([_flat(self.layers), _flat(self.first), _flat(self.second), [float(self.steps)]]).tobytes()

    def unpacked(self, data: bytes) -> State:
        values = np.frombuffer(data, dtype=np.float64)
        a, b = len(_flat(self.layers)), len(_flat(self.first))
        return State(_unflat(values[:a], self.layers), _unflat(values[a : a + b], self.first), _unflat(values[a + b : a + 2 * b], self.second), int(values[-1]))


def _minibatches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in pieces of ``size``; the last may be smaller."""
    x, y = None, np.zeros(0)
    for batch in batches:
        if not len(batch):
            continue
        new = batch["x"].flatten().to_numpy().reshape(len(batch), -1)
        x = new if x is None else np.concatenate([x, new])
        y = np.concatenate([y, batch["label"].to_numpy()])
        while len(y) >= size:
            yield x[:size], y[:size]
            x, y = x[size:], y[size:]
    if len(y):
        yield x, y


class _Exchange:
    """Adds up the messages of all tasks of a barrier stage, in the order of the tasks.

    Spark's exchange is used once, to agree on names that no earlier attempt had; messages are files,
    deleted as soon as all tasks have read them: a task that has all messages of a step knows that
    every task had those of the step before. In stores that only Spark can open, each message goes
    through Spark's exchange.
    """

    def __init__(self, context: BarrierTaskContext, folder: str):
        self.context, self.task, self.step, self.old = context, context.partitionId(), 0, None
        self.store, self.folder = arrow_store(folder) or (None, folder)
        if self.store is not None:
            self.store.create_dir(self.folder, recursive=True)
            ids = context.allGather(str(context.taskAttemptId()))
            self.tasks, self.attempt = len(ids), max(map(int, ids))

    def total(self, message: np.ndarray) -> np.ndarray:
        if self.store is None:
            sent = self.context.allGather(base64.b64encode(zlib.compress(message.tobytes(), 1)).decode())
            return sum(np.frombuffer(zlib.decompress(base64.b64decode(m)), dtype=np.float64) for m in sent)
        own = self._path(self.task)
        with self.store.open_output_stream(f"{own}.part") as out:
            out.write(message.tobytes())
        self.store.move(f"{own}.part", own)
        total = sum(message if t == self.task else self._read(self._path(t)) for t in range(self.tasks))
        if self.old:
            self.store.delete_file(self.old)
        self.old, self.step = own, self.step + 1
        return total

    def _path(self, task: int) -> str:
        return f"{self.folder}/{self.attempt}-{self.step}-{task}"

    def _read(self, path: str) -> np.ndarray:
        until, pause = time.monotonic() + WAIT_SECONDS, 0.0005
        while True:
            try:
                with self.store.open_input_file(path) as file:
                    return np.frombuffer(file.read(), dtype=np.float64)
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no message from another task: {path}") from None
                time.sleep(pause)
                pause = min(0.02, 1.5 * pause)


def _epoch(rows: DataFrame, state: State, s: NetworkSettings, tasks: int, epoch: int, rate: float) -> tuple[State, float]:
    """The state after one pass over the rows, and the mean loss in it."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(state.packed())
    folder = new_table_path(spark, "network-steps") if tasks > 1 else ""
    share = max(1, s.batch // tasks)
    like = State.start([{n: np.zeros_like(v) for n, v in layer.items()} for layer in state.layers])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get() if tasks > 1 else None
        task = context.partitionId() if context else 0
        exchange = _Exchange(context, folder) if context else None
        own = like.unpacked(shared.value)
        empty_grads = [{n: np.zeros_like(layer[n]) for n in _names(layer)} for layer in own.layers]
        empty_seen = [{n: np.zeros_like(layer[n]) for n in ("mean", "var")} for layer in own.layers[:-1]]
        todo = _minibatches(batches, share)
        loss = count = 0.0
        while True:
            x, y = next(todo, (None, np.zeros(0)))
            grads, seen, part = empty_grads, empty_seen, 0.0
            if len(y):
                r = np.random.default_rng([s.seed, epoch, own.steps, task])
                masks = [(r.random((len(y), n)) >= s.dropout) * (1 / (1 - s.dropout)) for n in s.hidden]
                part, grads, seen = gradients(own.layers, x, y, s, masks)
                # A batch's means count by its rows.
                seen = [{n: v * len(y) for n, v in layer.items()} for layer in seen]
            message = np.concatenate([[float(len(y)), part], _flat(grads), _flat(seen)])
            total = exchange.total(message) if exchange else message
            if not total[0]:
                break
            count, loss = count + total[0], loss + total[1]
            mean = total[2:] / total[0]
            size = len(_flat(empty_grads))
            own.step(_unflat(mean[:size], empty_grads), _unflat(mean[size:], empty_seen), rate)
        if task == 0:
            yield pa.RecordBatch.from_arrays([pa.array([own.packed()], pa.binary()), pa.array([loss / max(1.0, count)])], names=["state", "loss"])

    mixed = F.xxhash64("mark", F.lit(epoch + s.seed * 100_003))
    dealt = rows.withColumn("__order", mixed).repartition(tasks, "__order").sortWithinPartitions("__order", "mark", "label").drop("__order")
    row = dealt.mapInArrow(train, "state binary, loss double", barrier=tasks > 1).collect()[0]
    if folder:
        remove(spark, folder)
    return like.unpacked(bytes(row["state"])), row["loss"]


def _held_loss(rows: DataFrame, layers: Weights, classes: int | None) -> float | None:
    """Mean loss on the rows kept back; None without any. Losses are added as decimals, so that the
    order of rows and tasks does not change the sum."""
    shared = rows.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _minibatches(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(row_losses(outputs(shared.value, x, classes), y, classes))], names=["loss"])

    row = rows.mapInArrow(run, "loss double").agg(F.sum(F.col("loss").cast("decimal(28,10)")).alias("loss"), F.count("*").alias("n")).first()
    return float(row["loss"]) / row["n"] if row["n"] else None


@dataclass
class Network:
    """A fitted network: the weights of the best epoch, and ``history``, (loss, held-back loss,
    learning rate) by epoch."""

    settings: NetworkSettings
    layers: Weights
    history: list[tuple[float, float | None, float]]

    @property
    def numClasses(self) -> int | None:  # noqa: N802 - as MLlib names it
        return self.settings.classes

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``probability`` (ties: smaller class)."""
        shared = df.sparkSession.sparkContext.broadcast(self.layers)
        classes = self.settings.classes

        @F.pandas_udf("array<double>")
        def output(x: pd.Series) -> pd.Series:
            return pd.Series(list(outputs(shared.value, np.stack(x.to_numpy()), classes))) if len(x) else pd.Series([], dtype=object)

        out = df.withColumn("__out", output(vector_to_array(features)))
        if classes is None:
            return out.withColumn("prediction", F.get("__out", F.lit(0))).drop("__out")
        best = F.array_position("__out", F.array_max("__out")) - 1
        return out.withColumns({"probability": array_to_vector("__out"), "prediction": best.cast("double")}).drop("__out")

    def write(self) -> Network:
        return self

    def overwrite(self) -> Network:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        head = json.dumps({"settings": asdict(self.settings), "history": self.history})
        spark.createDataFrame([(head,)], "head string").write.mode("overwrite").text(f"{path}/head")
        rows = [(i, n, list(v.shape), v.ravel().tolist()) for i, layer in enumerate(self.layers) for n, v in layer.items()]
        spark.createDataFrame(rows, "layer int, name string, shape array<int>, cells array<double>").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, path: str) -> Network:
        spark = SparkSession.getActiveSession()
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        settings = NetworkSettings(**head["settings"] | {"hidden": tuple(head["settings"]["hidden"])})
        layers: Weights = [{} for _ in range(len(settings.hidden) + 1)]
        for r in spark.read.parquet(f"{path}/weights").collect():  # of the layers' size
            layers[r["layer"]][r["name"]] = np.array(r["cells"]).reshape(r["shape"])
        return cls(settings, layers, [tuple(h) for h in head["history"]])


@dataclass(frozen=True)
class NetworkEstimator:
    """``fit`` like an MLlib estimator: rows with ``key``, ``label`` and ``features``.

    Rows without a label are left out; without any there is nothing to learn: a ValueError. The rows
    kept back follow from a hash of the key, so reruns on as many cores agree. If none
    are kept back, the loss on the training rows decides.
    """

    key: str
    settings: NetworkSettings

    def fit(self, rows: DataFrame) -> Network:
        s, spark = self.settings, rows.sparkSession
        known = rows.where(F.col("label").isNotNull()).select(
            F.xxhash64(self.key, F.lit(s.seed)).alias("mark"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x")
        )
        path = new_table_path(spark, "network-rows")
        known.write.parquet(path)
        stored = spark.read.schema(known.schema).parquet(path)
        n_features = stored.agg(F.max(F.size("x"))).first()[0]
        if n_features is None:
            raise ValueError("no rows to learn from")
        back = F.pmod("mark", F.lit(1 << 20)) < int(s.held_back * (1 << 20))
        held, train = stored.where(back), stored.where(~back)
        n = train.count()
        if not n:
            train, n = stored, stored.count()
        tasks, s = s.sized(n, spark.sparkContext.defaultParallelism)
        state, rate = State.start(first_weights(n_features, s)), s.rate
        best, best_loss, bad, flat, lowest = state.layers, np.inf, 0, 0, np.inf
        history: list[tuple[float, float | None, float]] = []
        for epoch in range(s.epochs):
            state, loss = _epoch(train, state, s, tasks, epoch, rate)
            held_loss = _held_loss(held, state.layers, s.classes)
            history.append((loss, held_loss, rate))
            judged = loss if held_loss is None else held_loss
            if judged < best_loss:
                best, best_loss, bad = [dict(layer) for layer in state.layers], judged, 0
            else:
                bad += 1
            if bad >= s.patience:
                break
            # The rate falls when the loss has not fallen by a ten-thousandth for some epochs.
            flat = 0 if judged < lowest - 1e-4 else flat + 1
            lowest = min(lowest, judged)
            if flat >= s.slower_after:
                rate, flat = max(s.least_rate, rate * s.slower_by), 0
        remove(spark, path)
        return Network(s, best, history)
