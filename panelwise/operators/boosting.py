"""Boosted trees for several classes: one regression tree per class and round.

Every round fits the trees to the gradients of the softmax loss, all classes in the same jobs, with
the growth of ``forests``: exact split points, also where the rows do not fit one task. Leaves take
one Newton step; their sums are added as whole numbers of 2**-30, so that neither the order of the
rows nor of the tasks changes them.

Scores are not kept up to date by a shuffle: tasks add the trees since the last stored scores, which
are written anew every ``STORE_ROUNDS`` rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.forests import Flat, Growth, cut_points, descend, grow_branches, grow_tops, matrix, upper_nodes
from panelwise.session import new_table_path
from panelwise.sources.folders import remove

STORE_ROUNDS = 10
#: One is so many units in the sums of a leaf.
UNITS = float(1 << 30)

ARRAYS = ("feature", "threshold", "left", "right", "gain", "roots")


@dataclass(frozen=True)
class Boosting:
    classes: int
    rounds: int = 100
    rate: float = 0.1
    max_depth: int = 5
    min_split: int = 2
    min_leaf: int = 1
    seed: int = 42
    task_rows: int = 200_000

    @property
    def growth(self) -> Growth:
        return Growth(None, self.classes, self.max_depth, self.min_split, self.min_leaf, None, False, self.seed, self.task_rows)


@dataclass
class Round:
    """The trees of one round: nodes of all classes, ``roots`` by class, ``step`` of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, nodes: pa.Table) -> Round:
        nodes = nodes.sort_by([("tree", "ascending"), ("branch", "ascending"), ("node", "ascending")])
        flat = Flat.of(nodes)
        return cls(flat.feature, flat.threshold, flat.left, flat.right, nodes["gain"].to_numpy(), flat.roots, np.zeros(len(flat.left)))

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        return descend(x, np.full(len(x), self.roots[tree]), self.feature, self.threshold, self.left, self.right)

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.step[self.leaves(x, k)] for k in range(len(self.roots))], axis=1)


def shares(scores: np.ndarray) -> np.ndarray:
    """Softmax of each row."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Scorer:
    """Scores of a batch: those stored with it and the rounds since."""

    def __init__(self, recent: list[Round], rate: float):
        self.recent, self.rate = recent, rate
        self.seen: tuple[pa.RecordBatch | None, np.ndarray | None] = (None, None)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.seen[0] is not batch:
            x, scores = matrix(batch["x"]), matrix(batch["scores"])
            for r in self.recent:
                scores = scores + self.rate * r.steps(x)
            self.seen = (batch, scores)
        return self.seen[1]

    def residual(self, batch: pa.RecordBatch, k: int) -> np.ndarray:
        return (batch["label"].to_numpy() == k) - shares(self(batch))[:, k]


def _leaf_sums(rows: DataFrame, scorer: _Scorer, new: Round, classes: int) -> DataFrame:
    """(place, pull, slope): sums of the gradients and curvatures by leaf; at place -1 the loss and
    the rows before the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(new.left)
        sums, loss, count = np.zeros((2, n), dtype=np.int64), 0, 0
        for batch in batches:
            if not len(batch):
                continue
            x, p, label = matrix(batch["x"]), shares(scorer(batch)), batch["label"].to_numpy().astype(np.int64)
            count += len(label)
            loss += int(np.round(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)) * UNITS).astype(np.int64).sum())
            for k in range(classes):
                pull = (label == k) - p[:, k]
                leaf = new.leaves(x, k)
                np.add.at(sums[0], leaf, np.round(pull * UNITS).astype(np.int64))
                np.add.at(sums[1], leaf, np.round(np.abs(pull) * (1 - np.abs(pull)) * UNITS).astype(np.int64))
        place = np.flatnonzero(sums.any(axis=0))
        columns = [np.append(place, -1), np.append(sums[0][place], loss), np.append(sums[1][place], count)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["place", "pull", "slope"])

    made = rows.mapInArrow(run, "place bigint, pull bigint, slope bigint")
    return made.groupBy("place").agg(F.sum("pull").alias("pull"), F.sum("slope").alias("slope"))


@dataclass
class BoostedClasses:
    """Fitted rounds; ``losses`` are the mean losses on the training rows before each round and
    after the last."""

    settings: Boosting
    start: np.ndarray
    rounds: list[Round]
    losses: list[float]
    n_features: int

    @property
    def numClasses(self) -> int:  # noqa: N802 - as MLlib names it
        return self.settings.classes

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Mean over all trees of each feature's share in the tree's gain."""
        total = np.zeros(self.n_features)
        for r in self.rounds:
            tree = np.searchsorted(r.roots, np.arange(len(r.left)), side="right") - 1
            inner = r.left >= 0
            for k in range(self.settings.classes):
                mine = inner & (tree == k)
                gain = np.bincount(r.feature[mine], weights=r.gain[mine], minlength=self.n_features)
                if gain.sum() > 0:
                    total += gain / gain.sum()
        return DenseVector(total / total.sum() if total.sum() else total)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for r in self.rounds:
            out += self.settings.rate * r.steps(x)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``rawPrediction``, ``probability`` and ``prediction`` (ties: smaller class).
        The model's size follows from its settings, not from the rows."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.scores(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        scored = df.withColumn("__score", score(vector_to_array(features)))
        top = F.array_max("__score")
        raised = scored.withColumn("__part", F.transform("__score", lambda s: F.exp(s - top)))
        total = F.aggregate("__part", F.lit(0.0), lambda a, b: a + b)
        best = (F.array_position("__score", top) - 1).cast("double")
        return raised.withColumns(
            {"rawPrediction": array_to_vector("__score"), "probability": array_to_vector(F.transform("__part", lambda p: p / total)), "prediction": best}
        ).drop("__score", "__part")

    def write(self) -> BoostedClasses:
        return self

    def overwrite(self) -> BoostedClasses:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        head = {"settings": asdict(self.settings), "start": self.start.tolist(), "losses": self.losses, "n_features": self.n_features}
        spark.createDataFrame([(json.dumps(head),)], "head string").write.mode("overwrite").text(f"{path}/head")
        rows = [(i, json.dumps({name: getattr(r, name).tolist() for name in (*ARRAYS, "step")})) for i, r in enumerate(self.rounds)]
        spark.createDataFrame(rows, "round int, trees string").write.mode("overwrite").parquet(f"{path}/rounds")

    @classmethod
    def load(cls, path: str) -> BoostedClasses:
        spark = SparkSession.getActiveSession()
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        rounds = []
        for row in spark.read.parquet(f"{path}/rounds").orderBy("round").collect():  # of the settings' size
            cells = json.loads(row["trees"])
            kinds = {"threshold": float, "gain": float, "step": float}
            rounds.append(Round(**{name: np.array(cell, dtype=kinds.get(name, np.int64)) for name, cell in cells.items()}))
        return cls(Boosting(**head["settings"]), np.array(head["start"]), rounds, head["losses"], head["n_features"])


@dataclass(frozen=True)
class BoostingEstimator:
    """``fit`` like an MLlib estimator: rows with ``key``, ``label`` (class number) and ``features``.

    Rows without a label are left out; a class without rows gets the share of half a row. Rows are
    written once, and again with their scores every few rounds, when the older copy is deleted.
    """

    key: str
    settings: Boosting
    losses: list[float] = field(default_factory=list, compare=False)

    def fit(self, rows: DataFrame) -> BoostedClasses:
        s, spark = self.settings, rows.sparkSession
        known = rows.where(F.col("label").isNotNull())
        counts = np.zeros(s.classes)
        for r in known.groupBy("label").count().collect():  # one row per class
            counts[int(r["label"])] = r["count"]
        n = int(counts.sum())
        if not n:
            raise ValueError("no rows to learn from")
        start = np.log(np.maximum(counts, 0.5) / n)
        kept = known.select(
            F.xxhash64(self.key).alias("mark"), F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"), vector_to_array("features").alias("x"),
            F.array(*[F.lit(float(v)) for v in start]).alias("scores"),
        )
        schema = kept.schema
        path = new_table_path(spark, "boosting-rows")
        kept.write.parquet(path)
        stored = spark.read.schema(schema).parquet(path)
        n_features = stored.agg(F.max(F.size("x"))).first()[0]
        cuts = cut_points(stored, n, n_features, s.growth)
        rounds: list[Round] = []
        losses: list[float] = []
        recent: list[Round] = []
        for number in range(s.rounds + 1):
            scorer = _Scorer(recent, s.rate)
            if number == s.rounds:  # only the loss is left to be known
                new = Round(*[np.zeros(0)] * 5, np.zeros(0), np.zeros(0))
                sums = _leaf_sums(stored, scorer, new, 0).collect()
            else:
                tops = grow_tops(stored, n, n_features, s.growth, 0.0, scorer.residual, cuts)
                grown = grow_branches(stored, tops, list(range(s.classes)), s.growth, 0.0, scorer.residual).toArrow()
                new = Round.of(pa.concat_tables([grown, upper_nodes(tops).cast(grown.schema)]))
                sums = _leaf_sums(stored, scorer, new, s.classes).collect()  # one row per leaf
            by_place = {r["place"]: r for r in sums}
            losses.append(by_place[-1]["pull"] / UNITS / n)
            if number == s.rounds:
                break
            for place, r in by_place.items():
                if place >= 0 and r["slope"] > 0:
                    new.step[place] = (s.classes - 1) / s.classes * r["pull"] / r["slope"]
            rounds.append(new)
            recent = [*recent, new]
            if len(recent) == STORE_ROUNDS:
                newer = new_table_path(spark, "boosting-rows")
                _with_scores(stored, _Scorer(recent, s.rate)).write.parquet(newer)
                remove(spark, path)
                path, stored, recent = newer, spark.read.schema(schema).parquet(newer), []
        remove(spark, path)
        return BoostedClasses(s, start, rounds, losses, n_features)


def _with_scores(rows: DataFrame, scorer: _Scorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                scores = pa.array(list(scorer(batch)), pa.list_(pa.float64()))
                yield batch.set_column(batch.schema.get_field_index("scores"), "scores", scores)

    return rows.mapInArrow(run, rows.schema)
