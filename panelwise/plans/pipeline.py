"""The whole run: sources, features, models, explanations, report - each a stage on its own."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators import explain
from panelwise.operators.balance import balance_classes
from panelwise.operators.features import (
    body_features,
    demographic_features,
    dietary_features,
    interaction_features,
    log_features,
    polynomial_features,
    seasonal_features,
)
from panelwise.operators.joins import random_assignment_join
from panelwise.operators.metrics import best_models
from panelwise.operators.missing import impute, narrow_types
from panelwise.operators.models import Trained, scores_table, train_all
from panelwise.operators.panel import (
    panel_columns,
    panel_ratios,
    panel_statistics,
    rename_codes,
    sensitization_features,
)
from panelwise.operators.quality import validate_source
from panelwise.operators.targets import target_features
from panelwise.options import DEFAULT, Explaining, Thresholds, Training
from panelwise.session import written
from panelwise.sources.stages import final_report, load_report, load_table, save_report, save_table, stage_path
from panelwise.sources.synthetic import or_synthetic, synthetic_survey, synthetic_trial
from panelwise.vocabulary import ANALYTE_GROUPS, KEY

STEPS = ("ingestion", "engineering", "training", "analysis")


def derive_features(
    survey: DataFrame,
    trial: DataFrame | None = None,
    panel: Sequence[str] | None = None,
    groups: dict[str, Sequence[str]] = ANALYTE_GROUPS,
    key: str = KEY,
    trial_key: str = "subject_id",
    opts: Thresholds = DEFAULT,
    training: Training = Training(),
) -> DataFrame:
    """Flags, features and products from the measured values, before anything is filled in.

    All steps but the assignment of trial rows are projections of one stage.
    """
    panel = panel_columns(survey) if panel is None else list(panel)
    df = survey.transform(sensitization_features, panel, groups, opts)
    df = df.transform(demographic_features, opts=opts)
    df = df.transform(panel_statistics, panel).transform(panel_ratios)
    df = df.transform(seasonal_features).transform(body_features).transform(dietary_features)
    if trial is not None:
        df = random_assignment_join(df, trial, key, trial_key)
    if training.interactions:
        df = df.transform(interaction_features)
        df = df.transform(polynomial_features, degree=training.polynomial_degree)
    return df


def feature_table(
    survey: DataFrame,
    trial: DataFrame | None = None,
    panel: Sequence[str] | None = None,
    groups: dict[str, Sequence[str]] = ANALYTE_GROUPS,
    key: str = KEY,
    trial_key: str = "subject_id",
    opts: Thresholds = DEFAULT,
    training: Training = Training(),
    balance: bool = True,
    narrow: bool = True,
) -> DataFrame:
    """Derived features, filled, balanced, with logarithms and targets, in narrow types.

    The derived table is written once, because the statistics for filling and the filling itself
    both read it.
    """
    panel = panel_columns(survey) if panel is None else list(panel)
    derived = written(
        derive_features(survey, trial, panel, groups, key, trial_key, opts, training), "derived"
    )
    df = impute(derived, (key, "subject_id"))
    if balance:
        df = balance_classes(df, "poly_sensitized", key, opts, training)
    df = df.transform(log_features, panel).transform(target_features, opts=opts)
    return narrow_types(df) if narrow else df


@dataclass
class Run:
    """What the stages produced, and where they were saved."""

    folder: str
    status: str = "completed"
    error: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    trained: dict[str, Trained] = field(default_factory=dict)
    reports: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)


def ingest(
    spark: SparkSession,
    survey: DataFrame | None = None,
    trial: DataFrame | None = None,
    opts: Thresholds = DEFAULT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Survey (renamed), trial table, and the columns of the survey with too many nulls."""
    survey = rename_codes(or_synthetic(survey, lambda: synthetic_survey(spark)))
    trial = or_synthetic(trial, lambda: synthetic_trial(spark))
    return survey, trial, validate_source(survey, "survey", opts)


def run_pipeline(
    spark: SparkSession,
    folder: str,
    survey: DataFrame | None = None,
    trial: DataFrame | None = None,
    skip: Collection[str] = (),
    opts: Thresholds = DEFAULT,
    training: Training = Training(),
    explaining: Explaining = Explaining(),
    classifier_names: tuple[str, ...] = ("random_forest", "gradient_boosting", "logistic_regression", "neural_network"),
    validate: bool = True,
    resume: bool = False,
) -> Run:
    """Run the stages into ``folder``; a skipped stage is read from there.

    An error ends the run and is recorded in it; what was committed before stays. With ``resume``
    the run begins at the first step without a commit: the tables of earlier ones are read. Models
    are kept in memory only, so training and analysis are one step in this.
    """
    unknown = set(skip) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    if resume:
        skip = {*skip, *committed_steps(spark, folder)}
    run = Run(folder)
    try:
        _stages(spark, run, survey, trial, set(skip), opts, training, explaining, classifier_names, validate)
    except Exception as error:  # noqa: BLE001 - the run reports its failure as a result
        run.status, run.error = "failed", f"{type(error).__name__}: {error}"
    return run


#: Stages that a step commits.
_COMMITS = {
    "ingestion": ("survey", "trial", "high_missing"),
    "engineering": ("features",),
    "training": ("scores", "report"),
    "analysis": ("scores", "report"),
}


def committed_steps(spark: SparkSession, folder: str) -> list[str]:
    """The steps, from the first on, whose stages have all been committed."""
    done = []
    for step in STEPS:
        if any(stage_path(spark, f"{folder}/{name}") is None for name in _COMMITS[step]):
            break
        done.append(step)
    return done


def _stages(spark, run, survey, trial, skip, opts, training, explaining, classifier_names, validate):
    folder = run.folder
    if "ingestion" not in skip:
        survey, trial, high_missing = ingest(spark, survey, trial, opts)
        save_table(survey, f"{folder}/survey")
        save_table(trial, f"{folder}/trial")
        save_report(high_missing, f"{folder}/high_missing")
    run.tables["survey"] = load_table(spark, f"{folder}/survey")
    run.tables["trial"] = load_table(spark, f"{folder}/trial")
    if "engineering" not in skip:
        features = feature_table(run.tables["survey"], run.tables["trial"], opts=opts, training=training)
        save_table(features, f"{folder}/features")
    run.tables["features"] = load_table(spark, f"{folder}/features")
    results: dict[str, DataFrame] = {}
    summary = {
        "survey_rows": str(run.tables["survey"].count()),
        "survey_columns": str(len(run.tables["survey"].columns)),
        "feature_columns": str(len(run.tables["features"].columns)),
    }
    if "training" not in skip:
        keyed = with_row_key(run.tables["features"])
        run.trained = train_all(keyed, "row_key", training, classifier_names=classifier_names, validate=validate)
        scores = scores_table(spark, run.trained)
        save_report(scores, f"{folder}/scores")
        main = F.when(F.col("task") == "ige_regression", F.lit("r2_score")).otherwise(F.lit("f1_score"))
        best = best_models(
            scores.where(F.col("metric") == main).withColumnRenamed("value", "score")
        )
        run.tables["scores"], run.tables["best"] = scores, best
        results["best_models"] = best
        for row in best.collect():
            summary[f"best_{row['task']}"] = f"{row['model']} ({row['score']:.4f})"
    if "analysis" not in skip and run.trained:
        for task, done in run.trained.items():
            try:
                run.reports[task] = explain.explain_model(
                    done.models["random_forest"],
                    done.data.test,
                    "row_key",
                    done.data.features,
                    explaining,
                    training.seed,
                )
                top = [r["name"] for r in run.reports[task]["top"].limit(3).collect()]
                summary[f"top_{task}"] = ", ".join(top)
                results[f"importance_{task}"] = run.reports[task]["top"]
            except Exception as error:  # noqa: BLE001 - one model's failure must not stop the others
                run.failures[task] = f"{type(error).__name__}: {error}"
    settings = {
        "test_size": training.test_size,
        "trees": float(training.trees),
        "sensitized_at": opts.sensitized_at,
    }
    if skip >= {"training", "analysis"} and stage_path(spark, f"{folder}/report"):
        run.tables["report"] = load_report(spark, f"{folder}/report")
        return
    save_report(final_report(spark, settings, results, summary), f"{folder}/report")
    run.tables["report"] = load_report(spark, f"{folder}/report")


def with_row_key(df: DataFrame, key: str = KEY, out: str = "row_key") -> DataFrame:
    """A key that interpolated rows have too: the id, or a hash of the row's content without one."""
    content = F.xxhash64(*[c for c in df.columns if c != key])
    return df.withColumn(out, F.coalesce(F.col(key).cast("bigint"), content))
