"""Attribution of predictions to features, and the reports built from it.

Attributions are long tables (key, feature, [class_index,] phi). Reports aggregate them, so they
work alike for a few hundred explained rows and for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from panelwise.functions.hashing import as_key, mix
from panelwise.operators.forests import Forest
from panelwise.operators.ranking import exact_quantiles
from panelwise.options import Explaining
from panelwise.session import new_table_path, written
from panelwise.vocabulary import ANALYTE_GROUPS, CODE_NAMES

# --------------------------------------------------------------------------------------------
# rows to explain and background rows


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys (a report over the first rows, as the analysis asks for)."""
    return df.orderBy(key).limit(n)


def background_rows(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """n rows drawn by the hash of their key; the same rows on every run."""
    text = dict(df.dtypes)[key] == "string"
    order = mix(as_key(F.col(key), text), seed)
    return df.orderBy(order, key).limit(n)


# --------------------------------------------------------------------------------------------
# linear models


def linear_attribution(
    df: DataFrame,
    key: str,
    coefficients: dict[str, float],
    means: dict[str, float],
) -> DataFrame:
    """phi = coefficient * (value - background mean), one row per key and feature."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.lit(float(b)) * (F.col(f) - F.lit(float(means[f])))).alias("phi"),
            )
            for f, b in coefficients.items()
        ]
    )
    return df.select(key, F.explode(cells).alias("cell")).select(key, "cell.feature", "cell.phi")


def background_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


# --------------------------------------------------------------------------------------------
# tree ensembles


@dataclass(frozen=True)
class LeafPaths:
    """All root-to-leaf paths of an ensemble that test the same number of different features.

    For path p and its t-th feature: the open interval the value must lie in and the share of the
    training weight that follows the path at that feature.
    """

    features: np.ndarray  # (paths, t)
    low: np.ndarray  # value > low
    high: np.ndarray  # value <= high
    share: np.ndarray  # (paths, t)
    value: np.ndarray  # (paths, classes)


@dataclass(frozen=True)
class Ensemble:
    paths: tuple[LeafPaths, ...]
    base: np.ndarray
    n_features: int


#: Some 128 bytes each: a quarter of a gigabyte.
MAX_NODES = 2_000_000


def read_ensemble(model: Model | Forest, n_features: int) -> Ensemble:
    """Node tables of a fitted forest or boosted model, read from its saved form.

    The size is that of the model, not of the data; it is checked because it is broadcast.
    """
    if isinstance(model, Forest):
        nodes = model.nodes
    else:
        path = new_table_path(_session(), "model")
        model.write().overwrite().save(path)
        nodes = _session().read.parquet(f"{path}/data")
    if nodes.count() > MAX_NODES:
        raise ValueError("the ensemble has too many nodes to be sent to every executor")
    table = model.node_table() if isinstance(model, Forest) else nodes.select("treeID", "nodeData.*").toPandas()
    weights = list(getattr(model, "treeWeights", [])) or None
    n_trees = table["treeID"].nunique()
    classifier = getattr(model, "numClasses", None) is not None
    boosted = "GBT" in type(model).__name__
    if weights is None:
        weights = [1.0] * n_trees
    scale = 1.0 if boosted else 1.0 / n_trees
    found: dict[int, list] = {}
    base = 0.0
    for tree, rows in table.groupby("treeID"):
        base = base + _tree_paths(rows, weights[int(tree)] * scale, classifier and not boosted, found)
    groups = []
    for size, paths in sorted(found.items()):
        groups.append(LeafPaths(*[np.array([p[i] for p in paths]) for i in range(5)]))
    return Ensemble(tuple(groups), np.atleast_1d(base), n_features)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _tree_paths(rows: pd.DataFrame, weight: float, classes: bool, found: dict[int, list]) -> np.ndarray:
    """Collect the leaf paths of one tree by number of features; return its mean prediction."""
    node = {int(r.id): r for r in rows.itertuples(index=False)}

    def cover(r) -> float:
        stats = np.asarray(r.impurityStats, dtype=float)
        return float(stats.sum()) if classes else float(stats[0])

    def output(r) -> np.ndarray:
        if not classes:
            return np.array([r.prediction * weight])
        stats = np.asarray(r.impurityStats, dtype=float)
        return stats / stats.sum() * weight

    root = node[0]
    mean = 0.0
    stack = [(root, {})]
    while stack:
        r, tests = stack.pop()
        if r.leftChild < 0:
            names = sorted(tests)
            limits = [tests[f] for f in names]
            found.setdefault(len(names), []).append(
                (
                    np.array(names, dtype=np.int64),
                    np.array([t[0] for t in limits]),
                    np.array([t[1] for t in limits]),
                    np.array([t[2] for t in limits]),
                    output(r),
                )
            )
            mean = mean + output(r) * (np.prod([t[2] for t in limits]) if limits else 1.0)
            continue
        split = r.split
        feature, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        if split["numCategories"] != -1:
            raise ValueError("categorical splits are not used by these models")
        low, high, share = tests.get(feature, (-np.inf, np.inf, 1.0))
        for child, limits in (
            (node[r.leftChild], (low, min(high, threshold))),
            (node[r.rightChild], (max(low, threshold), high)),
        ):
            kept = share * cover(child) / cover(r)
            stack.append((child, {**tests, feature: (*limits, kept)}))
    return np.asarray(mean)


def path_attribution(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """(rows, features, classes) Shapley values of the path-dependent tree game.

    A leaf is reached by a coalition with the product over its features of 1 or 0 (feature known:
    does the value pass?) or the training share (unknown). Its Shapley values follow from the
    coefficients of the polynomial prod(share + pass * z), from which one feature's factor is
    divided out at a time (Lundberg et al., "From local explanations to global understanding with
    explainable AI for trees", 2020). All leaves with equally many features are done at once.
    """
    n_classes = len(ensemble.base)
    phi = np.zeros((len(x), ensemble.n_features, n_classes))
    for group in ensemble.paths:
        size = group.features.shape[1]
        if size == 0:
            continue
        weights = np.array([1.0 / (size * _choose(size - 1, k)) for k in range(size)])
        step = max(1, 2_000_000 // (len(group.value) * (size + 1)))
        for start in range(0, len(x), step):
            values = x[start : start + step][:, group.features]  # (rows, paths, size)
            passes = ((values > group.low) & (values <= group.high)).astype(float)
            share = np.broadcast_to(group.share, passes.shape)
            poly = np.zeros((*passes.shape[:2], size + 1))
            poly[..., 0] = 1.0
            for t in range(size):
                shifted = poly[..., :-1] * passes[..., t, None]
                poly *= share[..., t, None]
                poly[..., 1:] += shifted
            for t in range(size):
                others = _without(poly, share[..., t], passes[..., t])
                strength = (others @ weights) * (passes[..., t] - share[..., t])
                for c in range(n_classes):
                    gain = strength * group.value[:, c]
                    for f in np.unique(group.features[:, t]):
                        phi[start : start + step, f, c] += gain[:, group.features[:, t] == f].sum(axis=1)
    return phi


def _choose(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def _without(poly: np.ndarray, share: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Coefficients of the polynomial divided by (share + passed * z)."""
    size = poly.shape[-1] - 1
    out = np.empty((*poly.shape[:-1], size))
    on = passed > 0
    carry = poly[..., size].copy()
    # passed = 1: divide from the highest power down; passed = 0: a plain division by the share
    for k in range(size - 1, -1, -1):
        out[..., k] = np.where(on, carry, poly[..., k] / share)
        carry = poly[..., k] - carry * share
    return out


def tree_attribution(
    df: DataFrame, key: str, features: str, model: Model, names: Sequence[str]
) -> tuple[DataFrame, list[float]]:
    """(key, feature, class_index, phi) for every row, and the base value per class.

    The sum of a row's phi and the base is the model's output: the class probabilities of a
    forest, the mean of a regression forest, the margin of a boosted classifier.
    """
    ensemble = read_ensemble(model, len(names))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ensemble)
    n_classes = len(ensemble.base)
    rows = df.select(key, vector_to_array(features).alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                phi = path_attribution(shared.value, x)
                yield pd.DataFrame({key: batch[key], "phi": list(phi.reshape(len(x), -1))})

    key_type = df.schema[key].dataType.simpleString()
    wide = rows.mapInPandas(explain, f"{key} {key_type}, phi array<double>")
    labels = F.array(*[F.lit(n) for n in names])
    long = wide.select(key, F.posexplode("phi").alias("place", "phi"))
    place = F.col("place")
    out = long.select(
        key,
        F.get(labels, F.floor(place / n_classes).cast("int")).alias("feature"),
        (place % n_classes).alias("class_index"),
        "phi",
    )
    return out, [float(b) for b in ensemble.base]


# --------------------------------------------------------------------------------------------
# any model


def sampled_attribution(
    df: DataFrame,
    background: DataFrame,
    key: str,
    features: str,
    score: "callable",
    names: Sequence[str],
    draws: int = 20,
    seed: int = 42,
    limit: float | None = None,
    most_draws: int = 10_000,
) -> DataFrame:
    """Shapley values of any scored model from sampled feature orders: (key, feature, phi, std_error).

    A draw takes one background row and one order of the features, and replaces the background
    values by the row's own one after the other; every second draw takes the order before it
    backwards. ``score`` adds a ``score`` column to a DataFrame with a ``features`` vector. The sum
    of phi is the row's score minus the mean score of its background rows.

    ``std_error`` is that of the mean over the pairs of draws; null for a single pair. With a
    ``limit``, rows of which a feature's error is larger get as many draws again, until none is or
    ``most_draws`` are made.
    """
    kept = background.select(vector_to_array(features).alias("b")).limit(1_001).collect()
    if len(kept) > 1_000:
        raise ValueError("give at most 1000 background rows")
    backgrounds = [list(r["b"]) for r in kept]
    pairs = max(1, (draws + 1) // 2)
    sums = _paired_gains(df, backgrounds, key, features, score, len(names), 0, pairs, seed)
    n, spread = F.col("n"), F.col("squares") - F.col("total") * F.col("total") / F.col("n")
    error = F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1) / n))
    while limit is not None:
        sums = written(sums, "sampled-gains")
        rough = sums.where(error.isNull() | (error > limit)).select(key).distinct()
        if 4 * pairs > most_draws or rough.isEmpty():
            break
        again = df.join(rough, key, "left_semi")
        more = _paired_gains(again, backgrounds, key, features, score, len(names), pairs, pairs, seed)
        sums = sums.unionByName(more).groupBy(key, "place").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
        pairs *= 2
    labels = F.array(*[F.lit(name) for name in names])
    return sums.select(key, F.get(labels, F.col("place")).alias("feature"), (F.col("total") / n).alias("phi"), error.alias("std_error"))


def _paired_gains(df: DataFrame, backgrounds: list[list[float]], key: str, features: str, score: "callable", d: int, first: int, pairs: int, seed: int) -> DataFrame:
    """(key, place, n, total, squares) of the mean gains of the pairs of draws from ``first`` on."""
    text = dict(df.dtypes)[key] == "string"
    number = as_key(F.col(key), text)
    drawn = df.select(key, vector_to_array(features).alias("x"), F.explode(F.sequence(F.lit(first), F.lit(first + pairs - 1))).alias("pair"))
    slots = F.sequence(F.lit(0), F.lit(d - 1))
    random_key = mix(number + F.col("pair").cast("bigint") * F.lit(1_000_003), seed)
    keys = F.transform(slots, lambda j: F.struct(mix(random_key * F.lit(4_096) + j.cast("bigint"), seed).alias("u"), j.alias("j")))
    order = F.transform(F.array_sort(keys), lambda s: s["j"])
    chosen = drawn.select(
        key,
        "pair",
        "x",
        F.get(F.lit(backgrounds).cast("array<array<double>>"), (F.pmod(random_key + F.col("pair"), F.lit(len(backgrounds)))).cast("int")).alias("b"),
        F.posexplode(F.array(order, F.reverse(order))).alias("back", "order"),
    )
    steps = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    known = F.slice(F.col("order"), F.lit(1), F.col("step"))
    mixed = F.transform(
        slots,
        lambda j: F.when(F.array_contains(known, j), F.get(F.col("x"), j)).otherwise(F.get(F.col("b"), j)),
    )
    scored = score(
        steps.select(
            key,
            "pair",
            "back",
            "step",
            F.get("order", F.col("step") - 1).alias("place"),
            array_to_vector(mixed).alias("features"),
        )
    )
    before = F.lag("score").over(W.Window.partitionBy(key, "pair", "back").orderBy("step"))
    gains = scored.select(key, "pair", "place", (F.col("score") - before).alias("gain")).where(F.col("place").isNotNull())
    means = gains.groupBy(key, "pair", "place").agg(F.avg("gain").alias("gain"))
    return means.groupBy(key, "place").agg(F.count("*").alias("n"), F.sum("gain").alias("total"), F.sum(F.col("gain") * F.col("gain")).alias("squares"))


# --------------------------------------------------------------------------------------------
# dispatch


def attribution_kind(model: Model) -> str:
    """Which attribution fits a model: ``tree``, ``linear`` or ``sampled``."""
    name = type(model).__name__
    if "Forest" in name or "GBT" in name:
        return "tree"
    if "Linear" in name or "Logistic" in name:
        return "linear"
    return "sampled"


# --------------------------------------------------------------------------------------------
# names and groups


def readable_name(feature: Column) -> Column:
    """Display name: the meaning of a survey code in it (longest code first), else by its form."""
    lowered = F.lower(feature)
    chain = None
    for code in sorted(CODE_NAMES, key=lambda c: (-len(c), c)):
        test, value = lowered.contains(code.lower()), F.lit(CODE_NAMES[code])
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    plain = F.replace(feature, F.lit("_"), F.lit(" "))
    return (
        chain.when(
            feature.contains("sensitized"),
            F.concat(F.replace(feature, F.lit("_sensitized"), F.lit("")), F.lit(" Sensitization")),
        )
        .when(
            feature.contains("log_"),
            F.concat(F.lit("Log("), F.replace(feature, F.lit("log_"), F.lit("")), F.lit(")")),
        )
        .when(feature.startswith("poly_"), F.concat(F.lit("Polynomial "), feature))
        .otherwise(title_case(plain))
    )


def title_case(text: Column) -> Column:
    """Every letter that follows a non-letter is a capital, the others are small: also after digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-zÀ-ɏ]+|[^A-Za-zÀ-ɏ]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def analyte_group(feature: Column, groups: dict[str, Sequence[str]] = ANALYTE_GROUPS) -> Column:
    """Group whose member's name is part of the feature name; null for none."""
    chain = None
    for group, members in groups.items():
        test = reduce(lambda a, b: a | b, [feature.contains(m) for m in members])
        chain = F.when(test, F.lit(group)) if chain is None else chain.when(test, F.lit(group))
    return chain


# --------------------------------------------------------------------------------------------
# reports


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature over rows and classes, with its display name."""
    return (
        phi.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("importance"))
        .select("feature", readable_name(F.col("feature")).alias("name"), "importance")
    )


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def top_per_model(importance: DataFrame, n: int = 3) -> DataFrame:
    """The n most important features of each model, with their rank."""
    rank = F.row_number().over(W.Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    return importance.select("*", rank.alias("feature_rank")).where(F.col("feature_rank") <= n)


def attribution_matrix(phi: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Long attributions to one row per key: the columns are conditional sums."""
    cells = [F.sum(F.when(F.col("feature") == n, F.col("phi"))).alias(n) for n in names]
    return phi.groupBy(key).agg(*cells)


def attribution_correlation(
    wide: DataFrame, names: Sequence[str], threshold: float = 0.5, top: int = 10
) -> DataFrame:
    """Feature pairs with |r| above the threshold, strongest first.

    One pass computes the matrix; its size is the number of features squared. A constant column
    has no correlation.
    """
    vectors = VectorAssembler(inputCols=list(names), outputCol="v", handleInvalid="error").transform(wide)
    matrix = Correlation.corr(vectors.select("v"), "v").first()[0].toArray()
    spread = wide.agg(*[(F.max(n) > F.min(n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
    pairs = [
        (names[i], names[j], float(matrix[i, j]))
        for i in range(len(names))
        for j in range(i + 1, len(names))
        if spread[i] and spread[j] and abs(matrix[i, j]) > threshold
    ]
    table = wide.sparkSession.createDataFrame(
        pairs, "feature1 string, feature2 string, correlation double"
    )
    return table.orderBy(F.desc(F.abs("correlation")), "feature1", "feature2").limit(top)


def attribution_summary(phi: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and exact quartiles of all attribution values, in one row."""
    quartiles = exact_quantiles(phi, ["phi"], [0.25, 0.5, 0.75])["phi"]
    return phi.agg(
        F.avg("phi").alias("mean"),
        F.stddev_pop("phi").alias("std"),
        F.min("phi").alias("min"),
        F.max("phi").alias("max"),
        *[
            F.lit(q).cast("double").alias(name)
            for name, q in zip(("q25", "median", "q75"), quartiles)
        ],
    )


def group_importance(
    importance: DataFrame, groups: dict[str, Sequence[str]] = ANALYTE_GROUPS
) -> DataFrame:
    """Mean and maximum importance of each analyte group that has features; missing counts as 0."""
    value = F.coalesce(F.col("importance"), F.lit(0.0))
    grouped = importance.select(analyte_group(F.col("feature"), groups).alias("analyte_group"), value.alias("v"))
    return (
        grouped.where(F.col("analyte_group").isNotNull())
        .groupBy("analyte_group")
        .agg(
            F.count("*").alias("n_features"),
            F.avg("v").alias("mean_importance"),
            F.max("v").alias("max_importance"),
        )
    )


def model_comparison(importance: DataFrame, models: Sequence[str], top: int = 10) -> DataFrame:
    """Feature by model: importance among the model's top features, else 0."""
    best = top_per_model(importance, top)
    cells = [
        F.coalesce(F.max(F.when(F.col("model") == m, F.col("importance"))), F.lit(0.0)).alias(m)
        for m in models
    ]
    return best.groupBy("feature").agg(*cells)


def interaction_families(features: DataFrame) -> DataFrame:
    """Features that form the families age x total and season x outdoor: (family, role, feature).

    A family appears only if both of its roles do.
    """
    f = F.col("feature")
    lowered = F.lower(f)
    outdoor = f.rlike("Ragweed|grass|Oak|Birch")
    roles = [
        ("age_ige", "age", lowered.contains("age")),
        ("age_ige", "ige", lowered.contains("ige")),
        ("season_outdoor", "season", lowered.contains("season") | lowered.contains("month")),
        ("season_outdoor", "outdoor", outdoor),
    ]
    tags = F.array(
        *[F.when(test, F.struct(F.lit(a).alias("family"), F.lit(b).alias("role"))) for a, b, test in roles]
    )
    tagged = (
        features.select("feature")
        .distinct()
        .select("feature", F.explode(F.array_compact(tags)).alias("tag"))
        .select("tag.family", "tag.role", "feature")
    )
    complete = (
        tagged.groupBy("family").agg(F.count_distinct("role").alias("n")).where("n = 2").select("family")
    )
    return tagged.join(complete, "family", "left_semi")


# --------------------------------------------------------------------------------------------
# tables behind the plots


def summary_points(phi: DataFrame, rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Attribution beside the feature value, for the summary plot."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    )
    values = rows.select(key, F.explode(cells).alias("c")).select(key, "c.feature", "c.value")
    return phi.join(values, [key, "feature"])


def waterfall(phi: DataFrame, key: str, key_value, base: float) -> DataFrame:
    """One row's attributions, largest first, with the running prediction."""
    one = phi.where(F.col(key) == F.lit(key_value))
    order = W.Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), "feature")
    running = F.sum("phi").over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    return one.select(
        key,
        "feature",
        "phi",
        F.row_number().over(order).alias("place"),
        (running + F.lit(base)).alias("prediction_upto"),
    )


def force_table(phi: DataFrame, key: str, base: float, n: int = 100) -> DataFrame:
    """Attributions of the first n keys with base and prediction."""
    first = phi.select(key).distinct().orderBy(key).limit(n)
    chosen = phi.join(first, key, "left_semi")
    total = F.sum("phi").over(W.Window.partitionBy(key)) + F.lit(base)
    return chosen.select(key, "feature", "phi", F.lit(base).alias("base"), total.alias("prediction"))


def explain_model(
    model: Model,
    rows: DataFrame,
    key: str,
    names: Sequence[str],
    opts: Explaining = Explaining(),
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Importance, strongest pairs and summary of a model on the first rows by key."""
    chosen = first_rows(rows, key, opts.rows)
    kind = attribution_kind(model)
    if kind == "tree":
        phi, _ = tree_attribution(chosen, key, "features", model, names)
    elif kind == "linear":
        wide = chosen.select(key, vector_to_array("features").alias("x")).select(
            key, *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]
        )
        sample = background_rows(rows, key, opts.background, seed).select(
            key, vector_to_array("features").alias("x")
        ).select(*[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
        means = background_means(sample, names)
        if hasattr(model, "coefficientMatrix"):
            matrix = model.coefficientMatrix.toArray()
        else:
            matrix = model.coefficients.toArray()[None, :]
        parts = [
            linear_attribution(wide, key, dict(zip(names, map(float, row))), means).withColumn(
                "class_index", F.lit(i)
            )
            for i, row in enumerate(matrix)
        ]
        phi = reduce(lambda a, b: a.unionByName(b), parts)
    else:

        def score(df: DataFrame) -> DataFrame:
            scored = model.transform(df)
            if "probability" in scored.columns:
                return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
            return scored.withColumn("score", F.col("prediction"))

        sample = background_rows(rows, key, opts.background, seed)
        phi = sampled_attribution(chosen, sample, key, "features", score, names, seed=seed)
    phi = written(phi, "attribution")
    importance = global_importance(phi)
    reports = {
        "attribution": phi,
        "importance": importance,
        "top": top_features(importance, opts.top),
        "summary": attribution_summary(phi),
    }
    if "class_index" not in phi.columns or phi.agg(F.max("class_index")).first()[0] == 0:
        wide = attribution_matrix(phi, key, names)
        reports["pairs"] = attribution_correlation(wide, names, opts.strong_correlation, opts.top_pairs)
    return reports
