"""Targets for the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import first_present, upper_bins
from panelwise.operators.panel import elevated
from panelwise.options import DEFAULT, Thresholds
from panelwise.vocabulary import SEVERITY_STEPS, TOTAL_CLASSES, TOTAL_NAMES


def total_class(total: Column) -> Column:
    """Class of a total: the highest class whose lower limit it reaches.

    A missing total is ``Unknown``; one below every limit falls into the open last class.
    """
    chain = F.when(total.isNull(), F.lit("Unknown"))
    for name, low in reversed(TOTAL_CLASSES):
        chain = chain.when(total >= F.lit(low), F.lit(name))
    return chain.otherwise(F.lit(TOTAL_CLASSES[-1][0]))


def target_features(
    df: DataFrame, total: str | None = None, opts: Thresholds = DEFAULT
) -> DataFrame:
    total = total or first_present(df, *TOTAL_NAMES)
    new = []
    if total:
        new += [
            total_class(F.col(total)).alias("ige_class"),
            elevated(F.col(total), opts).alias("elevated_ige"),
        ]
    if "total_sensitizations" in df.columns:
        steps = upper_bins(F.col("total_sensitizations"), -0.1, SEVERITY_STEPS)
        new.append(steps.alias("sensitization_severity"))
    return df.select("*", *new)
