"""Synthetic survey and trial tables of any size.

Every value is a function of the row's id, so tasks need no shared state and a rerun gives the
same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.hashing import choice, clip, exponential, normal, uniform
from panelwise.vocabulary import ANALYTE_CODES, KEY, TOTAL_CODE

# Arms of the synthetic trial table.
TRIAL_STUDIES = ["observational_food", "peanut_sublingual", "peanut_epicutaneous"]
TRIAL_RESPONSES = ["responder", "non_responder", "partial"]


def survey_from_ids(ids: DataFrame, key: str) -> DataFrame:
    """One synthetic respondent per id: demographics, a total and the 15 panel values.

    A panel value is high with a chance that grows with the total.
    """
    ids = ids.select(F.col(key).cast("bigint").alias("id"))
    k = F.col("id")
    base = ids.select(
        "id",
        k.alias(KEY),
        choice(k, [1, 2], 1).alias("RIAGENDR"),
        clip(normal(k, 45.0, 20.0, 2), 2.0, 85.0).alias("RIDAGEYR"),
        choice(k, [1, 2, 3, 4, 5], 4).alias("RIDRETH1"),
        choice(k, [1, 2, 3, 4, 5], 5).alias("DMDEDUC2"),
        clip(exponential(k, 2.0, 6), 0.0, 5.0).alias("INDFMPIR"),
        normal(k, 3.5, 1.2, 7).alias("log_total"),
    )
    log_total = F.col("log_total")
    draws = []
    for i, code in enumerate(ANALYTE_CODES):
        draws += [uniform(k, 100 + 2 * i).alias(f"{code}_u"), exponential(k, 1.0, 101 + 2 * i).alias(f"{code}_e")]
    drawn = base.select(
        "*", (F.lit(0.3) / (F.lit(1.0) + F.exp(F.lit(3.5) - log_total))).alias("chance"), *draws
    )
    return drawn.select(
        *[c for c in base.columns if c not in ("log_total", "id")],
        clip(F.exp(log_total), 2.0, 5000.0).alias(TOTAL_CODE),
        *[_panel_value(code).alias(code) for code in ANALYTE_CODES],
    )


def _panel_value(code: str) -> Column:
    draw = F.col(f"{code}_e")
    high = draw * F.lit(2.0) + F.lit(0.35)
    low = draw * F.lit(0.1)
    return clip(F.when(F.col(f"{code}_u") < F.col("chance"), high).otherwise(low), 0.01, 100.0)


def synthetic_survey(spark: SparkSession, n: int = 1000) -> DataFrame:
    return survey_from_ids(spark.range(1, n + 1), "id")


def trial_from_ids(ids: DataFrame, key: str) -> DataFrame:
    """One synthetic trial subject per id."""
    k = F.col(key)
    return ids.select(
        F.format_string("SUB%04d", k.cast("bigint")).alias("subject_id"),
        choice(k, TRIAL_STUDIES, 201).alias("study"),
        clip(normal(k, 30.0, 15.0, 202), 5.0, 75.0).alias("age"),
        choice(k, ["Male", "Female"], 204).alias("gender"),
        F.exp(normal(k, 4.0, 1.0, 205)).alias("baseline_ige"),
        exponential(k, 2.0, 207).alias("peanut_ige"),
        exponential(k, 1.5, 208).alias("milk_ige"),
        exponential(k, 1.8, 209).alias("egg_ige"),
        choice(k, TRIAL_RESPONSES, 210).alias("treatment_response"),
    )


def synthetic_trial(spark: SparkSession, n: int = 500) -> DataFrame:
    return trial_from_ids(spark.range(1, n + 1), "id")


def or_synthetic(table: DataFrame | None, make) -> DataFrame:
    """The real table if it has rows, else a synthetic one."""
    return make() if table is None or table.isEmpty() else table
