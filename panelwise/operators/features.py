"""Row-local features: demographics, season, body, diet, products, powers and logarithms.

Each step adds its columns in one projection and runs only for the inputs that are columns of the
DataFrame (checked on the driver, without a job). All of them need no shuffle and fuse into the
stage that reads the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import band_flags, first_present, flag, present, upper_bins
from panelwise.operators.panel import panel_columns
from panelwise.options import DEFAULT, Thresholds
from panelwise.vocabulary import AGE_GROUPS, POLLEN_MONTHS, SEASON_MONTHS, TOTAL_NAMES

AGE = ("Age_years", "RIDAGEYR")
GENDER = ("Gender", "RIAGENDR")
INCOME = ("Poverty_income_ratio", "INDFMPIR")
EDUCATION = ("Education_level", "DMDEDUC2")
BODY_INDEX = ("BMI", "BMXBMI")
CALORIES = ("Calorie_intake", "DR1TKCAL")

# Energy per gram of each nutrient.
NUTRIENTS = {
    "protein": (("Protein_intake", "DR1TPROT"), 4),
    "fat": (("Fat_intake", "DR1TFAT"), 9),
    "carb": (("Carb_intake", "DR1TCARB"), 4),
}


def demographic_features(
    df: DataFrame,
    age: str | None = None,
    gender: str | None = None,
    income: str | None = None,
    education: str | None = None,
    opts: Thresholds = DEFAULT,
) -> DataFrame:
    new = []
    if age := age or first_present(df, *AGE):
        years = F.col(age)
        new += [
            upper_bins(years, 0.0, AGE_GROUPS).alias("age_group"),
            flag(years < 18).alias("is_child"),
            flag(years >= 65).alias("is_elderly"),
            (years * years).alias("age_squared"),
            (years * years * years).alias("age_cubed"),
        ]
    if gender := gender or first_present(df, *GENDER):
        new += [
            flag(F.col(gender) == code).alias(name) for name, code in (("is_male", 1), ("is_female", 2))
        ]
    if income := income or first_present(df, *INCOME):
        low, middle = opts.low_income, opts.middle_income
        new += band_flags(
            F.col(income),
            {"low_income": (None, low), "middle_income": (low, middle), "high_income": (middle, None)},
        )
    if education := education or first_present(df, *EDUCATION):
        level = F.col(education)
        new.append(flag(level < opts.high_school).alias("less_than_high_school"))
        levels = {"high_school": opts.high_school, "some_college": 4, "college_graduate": 5}
        new += [flag(level == code).alias(name) for name, code in levels.items()]
    return df.select("*", *new)


def seasonal_features(df: DataFrame, month: str = "interview_month") -> DataFrame:
    if month not in df.columns:
        return df
    m = F.col(month)
    season = reduce(
        lambda chain, item: chain.when(m.isin(*item[1]), item[0]),
        SEASON_MONTHS.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    angle = F.lit(2.0) * F.pi() * m / F.lit(12.0)
    return df.select(
        "*",
        season.alias("season"),
        *[flag(m.isin(*SEASON_MONTHS[s])).alias(f"season_{s}") for s in sorted(SEASON_MONTHS)],
        flag(m.isin(*POLLEN_MONTHS)).alias("high_pollen_season"),
        F.sin(angle).alias("month_sin"),
        F.cos(angle).alias("month_cos"),
    )


def body_features(
    df: DataFrame,
    body_index: str | None = None,
    height: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    new = []
    if body_index := body_index or first_present(df, *BODY_INDEX):
        index = F.col(body_index)
        new += band_flags(
            index,
            {
                "underweight": (None, 18.5),
                "normal_weight": (18.5, 25.0),
                "overweight": (25.0, 30.0),
                "obese": (30.0, None),
            },
        )
        new.append((index * index).alias("bmi_squared"))
    if height is None and weight is None:
        pairs = (("Height_cm", "Weight_kg"), ("BMXHT", "BMXWT"))
        found = next((pair for pair in pairs if len(present(df, pair)) == 2), None)
        height, weight = found or (None, None)
    if height and weight:
        ratio = F.when(F.col(weight) > 0, F.try_divide(F.col(height), F.col(weight))).otherwise(0.0)
        new.append(ratio.alias("height_weight_ratio"))
    return df.select("*", *new)


def dietary_features(
    df: DataFrame,
    calories: str | None = None,
    nutrients: dict[str, str] | None = None,
) -> DataFrame:
    """Energy share of each nutrient and calorie bands; nothing without a calorie column."""
    calories = calories or first_present(df, *CALORIES)
    if calories is None:
        return df
    energy = F.col(calories)
    new = []
    for name, (aliases, per_gram) in NUTRIENTS.items():
        grams = (nutrients or {}).get(name) or first_present(df, *aliases)
        if grams:
            share = F.try_divide(F.col(grams) * F.lit(float(per_gram)), energy + 1) * F.lit(100.0)
            new.append(share.alias(f"{name}_pct_calories"))
    new += band_flags(
        energy,
        {
            "low_calorie": (None, 1500.0),
            "normal_calorie": (1500.0, 2500.0),
            "high_calorie": (2500.0, None),
        },
    )
    return df.select("*", *new)


def interaction_features(
    df: DataFrame,
    age: str | None = None,
    body_index: str | None = None,
    total: str | None = None,
) -> DataFrame:
    age = age or first_present(df, *AGE)
    body_index = body_index or first_present(df, *BODY_INDEX)
    total = total or first_present(df, *TOTAL_NAMES)
    have = set(df.columns)
    new = []

    def product(left: str, right, name: str) -> None:
        new.append((F.col(left) * right).alias(name))

    if age and total:
        product(age, F.log1p(total), "age_ige_interaction")
    if age and "total_sensitizations" in have:
        product(age, F.col("total_sensitizations"), "age_sensitization_interaction")
    if body_index and total:
        product(body_index, F.log1p(total), "bmi_ige_interaction")
    if {"high_pollen_season", "outdoor_sensitizations"} <= have:
        product("high_pollen_season", F.col("outdoor_sensitizations"), "season_outdoor_interaction")
    return df.select("*", *new)


def polynomial_features(
    df: DataFrame,
    inputs: Sequence[str] = ("age_squared", "bmi_squared", "mean_specific_ige"),
    degree: int = 2,
    limit: int = 10,
) -> DataFrame:
    """``poly_0``, ``poly_1``, ...: all products up to the degree, by degree then input order."""
    inputs = present(df, inputs)
    if degree < 2 or not inputs:
        return df
    terms = [
        reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in chosen])
        for size in range(1, degree + 1)
        for chosen in combinations_with_replacement(inputs, size)
    ]
    return df.select("*", *[term.alias(f"poly_{i}") for i, term in enumerate(terms[:limit])])


def log_features(
    df: DataFrame, panel: Sequence[str] | None = None, total: str | None = None
) -> DataFrame:
    """``log1p`` of the total and of each panel column; null at -1 and below."""
    total = total or first_present(df, *TOTAL_NAMES)
    panel = panel_columns(df) if panel is None else present(df, panel)
    new = [F.log1p(total).alias("log_total_ige")] if total else []
    new += [F.log1p(c).alias(f"log_{c}") for c in panel]
    return df.select("*", *new)
