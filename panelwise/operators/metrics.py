"""Scores of predictions. Everything follows from small tables of counts, in one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.operators.ranking import totals_by_value


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """One row per actual class, one ``predicted_{class}`` column per class; all classes appear."""
    counts = confusion_counts(df, label, prediction)
    kind = df.schema[label].dataType
    every = df.sparkSession.createDataFrame([(str(c),) for c in classes], "actual string").select(
        F.col("actual").cast(kind).alias("actual")
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("predicted") == F.lit(c), F.col("n"))), F.lit(0))
        .cast("bigint")
        .alias(f"predicted_{c}")
        for c in classes
    ]
    return F.broadcast(every).join(counts, "actual", "left").groupBy("actual").agg(*cells)


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """support, predicted, hits and the three rates per class."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("actual").alias("class"),
            n.alias("support"),
            zero.alias("predicted_n"),
            F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("class"),
            zero.alias("support"),
            n.alias("predicted_n"),
            zero.alias("hits"),
        ),
    )
    long = confusion_counts(df, label, prediction).select(F.explode(roles).alias("r")).select("r.*")
    sums = long.groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted_n", "hits")]
    )
    hits = F.col("hits").cast("double")
    rated = sums.select(
        "*",
        F.coalesce(F.try_divide(hits, F.col("predicted_n")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hits, F.col("support")), F.lit(0.0)).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rated.select("*", f1.alias("f1_score"))


_RATES = ("precision", "recall", "f1_score")


def _weighted(rate: str) -> Column:
    return F.try_divide(F.sum(F.col(rate) * F.col("support")), F.sum("support"))


def classification_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    return _per_class(df, label, prediction).agg(
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
        *[_weighted(rate).alias(rate) for rate in _RATES],
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rates and support per class, then accuracy, macro and weighted averages."""
    classes = _per_class(df, label, prediction)
    rows = classes.select(F.col("class").cast("string").alias("entry"), *_RATES, "support")
    support = F.sum("support").alias("support")
    accuracy = F.try_divide(F.sum("hits").cast("double"), F.sum("support"))
    whole = [
        classes.agg(*[accuracy.alias(r) for r in _RATES], support).select(
            F.lit("accuracy").alias("entry"), "*"
        ),
        classes.agg(*[F.avg(r).alias(r) for r in _RATES], support).select(
            F.lit("macro avg").alias("entry"), "*"
        ),
        classes.agg(*[_weighted(r).alias(r) for r in _RATES], support).select(
            F.lit("weighted avg").alias("entry"), "*"
        ),
    ]
    for part in whole:
        rows = rows.unionByName(part)
    return rows


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of a 0/1 label, ties counted half; null unless both occur."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    by_score = totals_by_value(
        known,
        score,
        {"positives": (F.col(label) == 1).cast("int"), "negatives": (F.col(label) == 0).cast("int")},
    )
    p, n, upto = F.col("positives"), F.col("negatives"), F.col("negatives_upto")
    won = F.sum(p * (upto.cast("double") - n / F.lit(2.0)))
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return by_score.agg(F.try_divide(won, pairs).alias("roc_auc"))


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mse, rmse, mae, r2 and explained variance from one aggregate."""
    y = F.col(label).cast("double")
    gap = y - F.col(prediction).cast("double")
    sums = df.agg(
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.var_pop(y).alias("spread"),
        F.var_pop(gap).alias("left"),
    )
    mse, spread = F.col("mse"), F.col("spread")
    r2 = F.when(spread == 0, F.when(mse == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - F.try_divide(mse, spread)
    )
    return sums.select(
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        r2.alias("r2_score"),
        (1.0 - F.try_divide(F.col("left"), spread)).alias("explained_variance"),
    )


def best_models(scores: DataFrame) -> DataFrame:
    """Per task the model with the highest score; the first (lowest ordinal) wins ties.

    Expects task, model, ordinal, score.
    """
    ranked = F.struct(F.col("score"), -F.col("ordinal"), F.col("model"))
    best = scores.groupBy("task").agg(F.max(ranked).alias("best"))
    return best.select("task", F.col("best.model").alias("model"), F.col("best.score").alias("score"))
