"""Metrics, models, explanations and the pipeline."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwise.operators import explain, metrics, models, prepare
from panelwise.options import Explaining, Training
from panelwise.plans.pipeline import committed_steps, feature_table, run_pipeline
from panelwise.operators.panel import rename_codes
from panelwise.sources.stages import load_report
from panelwise.sources.synthetic import synthetic_survey

SMALL = Training(trees=6, max_depth=4, boost_rounds=4, hidden=(8,), network_iterations=20, folds=2)


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p int, s double")


def test_classification_metrics(spark):
    df = scored(spark, [(0, 0, 0.1)] * 6 + [(0, 1, 0.6)] * 2 + [(1, 1, 0.8)] * 3 + [(1, 0, 0.1)] + [(2, 0, 0.3)])
    row = metrics.classification_scores(df, "y", "p").first()
    assert row["accuracy"] == pytest.approx(9 / 13)
    precision = (8 * 6 / 8 + 4 * 3 / 5 + 0) / 13
    assert row["precision"] == pytest.approx(precision) and row["recall"] == pytest.approx(9 / 13)
    report = {r["entry"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert report["2"]["f1_score"] == 0.0 and report["2"]["support"] == 1
    assert report["macro avg"]["recall"] == pytest.approx((6 / 8 + 3 / 4 + 0) / 3)
    matrix = {r["actual"]: (r["predicted_0"], r["predicted_1"], r["predicted_2"]) for r in metrics.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()}
    assert matrix == {0: (6, 2, 0), 1: (1, 3, 0), 2: (1, 0, 0)}


def test_area_counts_ties_half(spark):
    df = scored(spark, [(1, 0, 0.5), (0, 0, 0.5), (1, 0, 0.9), (0, 0, 0.1)])
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(3.5 / 4)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = metrics.regression_scores(df, "y", "p").first()
    y, p = np.array([1.0, 2, 4]), np.array([2.0, 2, 3])
    assert row["mse"] == pytest.approx(((y - p) ** 2).mean()) and row["rmse"] == pytest.approx(math.sqrt(row["mse"]))
    assert row["r2_score"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["explained_variance"] == pytest.approx(1 - (y - p).var() / y.var())
    constant = metrics.regression_scores(df.select(F.lit(1.0).alias("y"), "p"), "y", "p").first()
    assert constant["r2_score"] == 0.0 and constant["explained_variance"] is None


def test_first_model_wins_ties(spark):
    df = spark.createDataFrame(
        [("t", "b", 1, 0.5), ("t", "a", 0, 0.5), ("t", "c", 2, 0.4)], "task string, model string, ordinal int, score double"
    )
    assert metrics.best_models(df).first()["model"] == "a"


@pytest.fixture(scope="module")
def features(spark):
    survey = rename_codes(synthetic_survey(spark, 400))
    return feature_table(survey, balance=False).persist()


def test_synthetic_survey_gives_96_columns(features):
    assert len(features.columns) == 96 and features.count() == 400


def test_classifiers_and_importances(spark, features):
    columns = ["Total_IgE", "Age_years", "Peanut", "Milk", "mean_specific_ige"]
    data = prepare.model_input(features, "poly_sensitized", "SEQN", features=columns)
    done = models.train_classifiers(data, "SEQN", "poly", SMALL)
    assert list(done.models) == ["random_forest", "gradient_boosting", "logistic_regression", "neural_network"]
    assert done.score("random_forest", "accuracy") > 0.6
    assert 0.5 < done.score("random_forest", "roc_auc") <= 1
    assert done.score(done.best, "cv_mean") is not None and done.score(done.best, "cv_std") is not None
    table = models.importance_table(spark, done).collect()
    assert sum(r["importance"] for r in table if r["model"] == "random_forest") == pytest.approx(1.0)
    assert {r["basis"] for r in table if r["model"] == "logistic_regression"} == {"absolute coefficient"}
    assert [r["importance"] for r in table if r["model"] == "neural_network"] == [None]


def test_multiclass_boosting_and_models_on_disk(spark, features, tmp_path):
    columns = ["Age_years", "Peanut", "mean_specific_ige", "max_specific_ige"]
    data = prepare.model_input(features, "ige_class", "SEQN", features=columns)
    done = models.train_classifiers(data, "SEQN", "ige_class", SMALL, ("random_forest", "gradient_boosting"), validate=False)
    assert done.score("gradient_boosting", "f1_score") is not None
    assert done.score("random_forest", "roc_auc") is None
    models.save_models({"ige_class": done}, str(tmp_path))
    kind = type(done.models["random_forest"])
    loaded = models.load_models(spark, str(tmp_path), {"ige_class/random_forest": kind})["ige_class/random_forest"]
    assert loaded.getNumTrees == 6
    kept = spark.read.json(f"{tmp_path}/ige_class/preparation").first()
    assert kept["features"] == columns and "Normal" in kept["classes"]


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [2.0, -1.0, 0.5] + rng.normal(size=60) + 4
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    df = prepare.assemble(spark.createDataFrame(rows, "a double, b double, c double, label double"), ["a", "b", "c"])
    fitted = models.ridge_regressor(Training(ridge_alpha=5.0), 60, float(y.std())).fit(df)
    exact = np.linalg.solve(x.T @ x + 5.0 * np.eye(3), x.T @ (y - y.mean()))
    assert np.allclose(fitted.coefficients.toArray(), exact, atol=1e-8)


def brute_shapley(value, n):
    """Shapley values of a set function by definition."""
    phi = np.zeros(n)
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            for chosen in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                phi[f] += weight * (value({*chosen, f}) - value(set(chosen)))
    return phi


def test_tree_attribution_by_definition():
    ensemble = explain.Ensemble(
        paths=(
            explain.LeafPaths(  # two leaves under one feature
                np.array([[0], [0]]), np.array([[-np.inf], [1.0]]), np.array([[1.0], [np.inf]]), np.array([[0.25], [0.75]]), np.array([[2.0], [6.0]])
            ),
            explain.LeafPaths(
                np.array([[0, 1, 2], [0, 1, 2]]),
                np.array([[-np.inf, 0.0, -1.0], [2.0, -np.inf, -np.inf]]),
                np.array([[3.0, np.inf, 1.0], [np.inf, 0.0, np.inf]]),
                np.array([[0.5, 0.4, 0.3], [0.2, 0.6, 1.0]]),
                np.array([[5.0], [-3.0]]),
            ),
        ),
        base=np.array([0.0]),
        n_features=4,
    )
    x = np.array([[0.5, 1.0, 0.0, 9.0], [2.5, -1.0, 4.0, 9.0], [5.0, 0.0, 0.5, 9.0]])
    phi = explain.path_attribution(ensemble, x)[..., 0]

    def value(row, known):
        total = 0.0
        for group in ensemble.paths:
            for p in range(len(group.value)):
                part = group.value[p, 0]
                for t, f in enumerate(group.features[p]):
                    inside = group.low[p, t] < row[f] <= group.high[p, t]
                    part *= float(inside) if f in known else group.share[p, t]
                total += part
        return total

    for i, row in enumerate(x):
        assert np.allclose(phi[i], brute_shapley(lambda s: value(row, s), 4))


@pytest.mark.parametrize("kind", ["forest", "boosted", "regression"])
def test_attributions_add_up(spark, features, kind):
    columns = ["Total_IgE", "Age_years", "Peanut", "Milk", "mean_specific_ige", "std_specific_ige"]
    if kind == "regression":
        data = prepare.model_input(features, "max_specific_ige", "SEQN", False, columns)
        model = models.forest_regressor(SMALL).fit(data.train)
        predicted = model.transform(data.test).select("SEQN", F.col("prediction").alias("out"))
    else:
        data = prepare.model_input(features, "poly_sensitized", "SEQN", features=columns)
        make = models.forest_classifier(SMALL) if kind == "forest" else models.boosted_classifier(SMALL, 2)
        model = make.fit(data.train)
        source = "probability" if kind == "forest" else "rawPrediction"
        predicted = model.transform(data.test).select("SEQN", F.get(vector_to_array(source), F.lit(1)).alias("out"))
    phi, base = explain.tree_attribution(data.test, "SEQN", "features", model, columns)
    last = phi.where(F.col("class_index") == len(base) - 1)
    total = last.groupBy("SEQN").agg(F.sum("phi").alias("phi")).join(predicted, "SEQN")
    gap = total.select(F.max(F.abs(F.col("phi") + base[-1] - F.col("out")))).first()[0]
    assert gap < 1e-9


def test_sampled_attribution_adds_up(spark):
    rows = [(i, float(i % 3), float(i % 5), float(i % 2)) for i in range(12)]
    df = prepare.assemble(spark.createDataFrame(rows, "id bigint, a double, b double, c double"), ["a", "b", "c"])
    df = df.select("id", "features")

    def score(d):
        x = vector_to_array("features")
        return d.withColumn("score", F.get(x, F.lit(0)) * F.get(x, F.lit(1)) + F.get(x, F.lit(2)))

    background = explain.background_rows(df, "id", 1)
    phi = explain.sampled_attribution(df, background, "id", "features", score, ["a", "b", "c"], draws=6)
    base = score(background).first()["score"]
    sums = phi.groupBy("id").agg(F.sum("phi").alias("t")).join(score(df), "id")
    assert sums.select(F.max(F.abs(F.col("t") + base - F.col("score")))).first()[0] < 1e-9


def test_sampled_attribution_within_its_error(spark):
    """Four features that work together: by definition, and within the stated error."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 4)).round(3)
    names = ["a", "b", "c", "d"]
    df = prepare.assemble(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, c double, d double"), names).select("id", "features")

    def score(d):
        v = [F.get(vector_to_array("features"), F.lit(i)) for i in range(4)]
        return d.withColumn("score", v[0] * v[1] + F.when(v[2] > 0, v[3] * v[0]).otherwise(v[1]))

    plain = lambda v: v[0] * v[1] + (v[3] * v[0] if v[2] > 0 else v[1])
    base = rng.normal(size=4).round(3)
    background = prepare.assemble(spark.createDataFrame([(0, *map(float, base))], "id bigint, a double, b double, c double, d double"), names)
    found = explain.sampled_attribution(df, background, "id", "features", score, names, draws=10, limit=0.04, most_draws=640)
    rows = {(r["id"], r["feature"]): r for r in found.collect()}
    assert len(rows) == 24 and all(r["std_error"] <= 0.04 for r in rows.values())
    few = explain.sampled_attribution(df, background, "id", "features", score, names, draws=10).collect()
    assert max(r["std_error"] for r in few) > 0.04
    for i in range(6):
        exact = brute_shapley(lambda s: plain([x[i][f] if f in s else base[f] for f in range(4)]), 4)
        for f, name in enumerate(names):
            r = rows[i, name]
            assert abs(r["phi"] - exact[f]) <= 4 * r["std_error"] + 1e-9
    one = explain.sampled_attribution(df, background, "id", "features", score, names, draws=1).collect()
    assert {r["std_error"] for r in one} == {None}


@pytest.mark.parametrize(
    "feature, name",
    [
        ("LBXF24_sensitized", "Shrimp"),
        ("log_lbxf2", "Milk"),
        ("LBXF13", "Peanut"),
        ("Cat_epithelium_sensitized", "Cat_epithelium Sensitization"),
        ("log_total_ige", "Log(total_ige)"),
        ("poly_3", "Polynomial poly_3"),
        ("age_ige_interaction", "Age Ige Interaction"),
        ("ige_25percentile", "Ige 25Percentile"),
        ("mean_specific_ige", "Mean Specific Ige"),
    ],
)
def test_readable_names(spark, feature, name):
    df = spark.createDataFrame([(feature,)], "feature string")
    assert df.select(explain.readable_name(F.col("feature"))).first()[0] == name


def test_kind_of_attribution(spark):
    class RandomForestRegressionModel: ...

    class LogisticRegressionModel: ...

    class OneVsRestModel: ...

    kinds = [explain.attribution_kind(k()) for k in (RandomForestRegressionModel, LogisticRegressionModel, OneVsRestModel)]
    assert kinds == ["tree", "linear", "sampled"]


def test_explanations_of_each_kind(spark, features):
    columns = ["Age_years", "Peanut", "Milk", "std_specific_ige"]
    data = prepare.model_input(features, "poly_sensitized", "SEQN", features=columns)
    done = models.train_classifiers(data, "SEQN", "poly", SMALL, ("random_forest", "logistic_regression", "neural_network"), validate=False)
    opts = Explaining(background=10, rows=15, top=3)
    for name, model in done.models.items():
        reports = explain.explain_model(model, done.data.test, "SEQN", columns, opts)
        assert reports["top"].count() == 3, name
        assert reports["summary"].first()["std"] >= 0, name
        assert reports["attribution"].select("SEQN").distinct().count() == 15, name


def test_pipeline_runs_skips_and_fails(spark, tmp_path):
    folder = str(tmp_path / "run")
    survey = synthetic_survey(spark, 300)
    opts = Explaining(rows=20)
    names = ("random_forest", "logistic_regression")
    run = run_pipeline(spark, folder, survey, training=SMALL, explaining=opts, classifier_names=names, validate=False)
    assert run.status == "completed", run.error
    assert set(run.trained) == {"poly_sensitization", "ige_class", "ige_regression"}
    assert set(run.reports) == set(run.trained) and not run.failures
    report = load_report(spark, f"{folder}/report").first()
    assert report["summary"]["survey_rows"] == "300" and "best_ige_class" in report["summary"].asDict()
    again = run_pipeline(spark, folder, skip=("ingestion", "engineering", "training", "analysis"))
    assert again.status == "completed" and len(again.tables["features"].columns) >= 96
    assert committed_steps(spark, folder) == ["ingestion", "engineering", "training", "analysis"]
    resumed = run_pipeline(spark, folder, resume=True)
    assert resumed.status == "completed" and resumed.tables["report"].first()["summary"]["survey_rows"] == "300" and not resumed.trained
    failed = run_pipeline(spark, str(tmp_path / "nothing"), skip=("ingestion",))
    assert failed.status == "failed" and "nothing" in failed.error
    with pytest.raises(ValueError, match="unknown steps"):
        run_pipeline(spark, folder, skip=("cooking",))
