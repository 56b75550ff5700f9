"""Values at every boundary of the feature rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from panelwise.functions.columns import nan_as_null, safe_divide
from panelwise.operators import features as feat
from panelwise.operators.panel import (
    columns_with_stem,
    panel_columns,
    panel_ratios,
    panel_statistics,
    pivot_panel,
    rename_codes,
    sensitization_features,
)
from panelwise.operators.targets import target_features


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def numbered(spark, name, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, {name} {kind}")


def test_flags_of_a_small_panel(spark):
    df = spark.createDataFrame(
        [(0, 0.1, 0.2, 0.05), (1, 0.5, 0.4, 0.35), (2, 1.0, 0.8, 2.0)],
        "id int, LBXD1 double, LBXE1 double, LBXF13 double",
    )
    out = sensitization_features(df)
    for c in ("LBXD1", "LBXE1", "LBXF13"):
        assert column(out, f"{c}_sensitized") == [0, 1, 1]
    assert column(out, "total_sensitizations") == [0, 3, 3]
    assert column(out, "any_sensitization") == [0, 1, 1]
    assert column(out, "poly_sensitized") == [0, 1, 1]


def test_flag_boundaries_and_missing_cells(spark):
    df = numbered(spark, "Peanut", [None, 0.0, 0.3499, 0.35, 100.0])
    out = sensitization_features(df, ["Peanut"])
    assert column(out, "Peanut_sensitized") == [None, 0, 0, 1, 1]
    assert column(out, "total_sensitizations") == [0, 0, 0, 1, 1]
    assert column(out, "food_sensitizations") == [0, 0, 0, 1, 1]
    assert "indoor_sensitizations" not in out.columns


def test_panel_is_found_by_name(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], "SEQN int, LBXIGE double, LBXD1 double, Oak double, myIgE double")
    assert panel_columns(df) == ["LBXD1", "Oak", "myIgE"]
    assert panel_columns(df, with_total=True) == ["LBXIGE", "LBXD1", "Oak", "myIgE"]
    assert columns_with_stem(rename_codes(df), ["Dermato"]) == ["Dermatophagoides_farinae"]
    assert rename_codes(df).columns == ["SEQN", "Total_IgE", "Dermatophagoides_farinae", "Oak", "myIgE"]


def test_row_statistics_skip_missing_cells(spark):
    df = spark.createDataFrame(
        [
            (0, None, None, None, 10.0),
            (1, None, 4.0, None, 10.0),
            (2, 1.0, None, 2.0, 0.0),
            (3, 5.0, 5.0, 2.0, None),
        ],
        "id int, a double, b double, c double, Total_IgE double",
    )
    out = panel_ratios(panel_statistics(df, ["a", "b", "c"]))
    assert column(out, "mean_specific_ige") == [None, 4.0, 1.5, 4.0]
    assert column(out, "median_specific_ige") == [None, 4.0, 1.5, 5.0]
    assert column(out, "max_specific_ige") == [None, 4.0, 2.0, 5.0]
    assert column(out, "min_specific_ige") == [None, 4.0, 1.0, 2.0]
    std = column(out, "std_specific_ige")
    assert std[:2] == [None, None]
    assert std[2:] == pytest.approx([math.sqrt(0.5), math.sqrt(3.0)])
    assert column(out, "ige_25percentile") == [None, 4.0, 1.25, 3.5]
    assert column(out, "ige_75percentile") == [None, 4.0, 1.75, 5.0]
    assert column(out, "ige_iqr") == [None, 0.0, 0.5, 1.5]
    assert column(out, "specific_to_total_ratio") == [None, 0.4, None, None]
    assert column(out, "max_specific_to_total_ratio") == [None, 0.4, None, None]


def test_long_results_become_a_panel(spark):
    df = spark.createDataFrame(
        [("s1", "x", 1.0), ("s1", "x", 3.0), ("s1", "y", 5.0), ("s2", "z", 9.0)], "s string, a string, v double"
    )
    out = {r["s"]: (r["x"], r["y"], r["t"]) for r in pivot_panel(df, ["s"], "a", "v", ["x", "y"], "t").collect()}
    assert out == {"s1": (2.0, 5.0, 9.0), "s2": (None, None, 9.0)}


def test_age_limits(spark):
    ages = [None, 0.0, 6.0, 6.01, 12.0, 17.99, 18.0, 40.0, 60.0, 65.0, 100.0, 101.0]
    out = feat.demographic_features(numbered(spark, "RIDAGEYR", ages))
    assert column(out, "age_group") == [
        None, None, "preschool", "school_age", "school_age", "adolescent", "adolescent",
        "young_adult", "middle_age", "elderly", "elderly", None,
    ]
    assert column(out, "is_child") == [0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert column(out, "is_elderly") == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert column(out, "age_squared")[0] is None
    assert column(out, "age_cubed")[7] == 64000.0


def test_gender_income_education(spark):
    df = spark.createDataFrame(
        [(0, None, None, None), (1, 0, 1.29, 1), (2, 1, 1.3, 3), (3, 2, 3.49, 4), (4, 2, 3.5, 5)],
        "id int, Gender int, Poverty_income_ratio double, Education_level int",
    )
    out = feat.demographic_features(df)
    assert column(out, "is_male") == [0, 0, 1, 0, 0]
    assert column(out, "is_female") == [0, 0, 0, 1, 1]
    assert column(out, "low_income") == [0, 1, 0, 0, 0]
    assert column(out, "middle_income") == [0, 0, 1, 1, 0]
    assert column(out, "high_income") == [0, 0, 0, 0, 1]
    assert column(out, "less_than_high_school") == [0, 1, 0, 0, 0]
    assert column(out, "high_school") == [0, 0, 1, 0, 0]
    assert column(out, "some_college") == [0, 0, 0, 1, 0]
    assert column(out, "college_graduate") == [0, 0, 0, 0, 1]


def test_friendly_name_wins_over_code(spark):
    df = spark.createDataFrame([(0, 10.0, 70.0)], "id int, Age_years double, RIDAGEYR double")
    assert column(feat.demographic_features(df), "is_child") == [1]


def test_seasons(spark):
    out = feat.seasonal_features(numbered(spark, "interview_month", [None, *range(1, 13)], "int"))
    names = ["winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "fall", "fall", "fall", "winter"]
    assert column(out, "season") == [None, *names]
    assert column(out, "season_winter") == [0] + [int(n == "winter") for n in names]
    assert column(out, "high_pollen_season") == [0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0]
    assert column(out, "month_sin")[3] == pytest.approx(1.0)
    assert column(out, "month_cos")[6] == pytest.approx(-1.0)
    assert column(out, "month_sin")[0] is None


def test_body(spark):
    df = spark.createDataFrame(
        [(0, None, 170.0, None), (1, 18.49, 170.0, 0.0), (2, 18.5, 170.0, -1.0), (3, 25.0, None, 70.0), (4, 30.0, 175.0, 70.0)],
        "id int, BMXBMI double, BMXHT double, BMXWT double",
    )
    out = feat.body_features(df)
    assert column(out, "underweight") == [0, 1, 0, 0, 0]
    assert column(out, "normal_weight") == [0, 0, 1, 0, 0]
    assert column(out, "overweight") == [0, 0, 0, 1, 0]
    assert column(out, "obese") == [0, 0, 0, 0, 1]
    assert column(out, "bmi_squared")[4] == 900.0
    assert column(out, "height_weight_ratio") == [0.0, 0.0, 0.0, None, 2.5]


def test_diet(spark):
    df = spark.createDataFrame(
        [(0, None, 1.0), (1, 0.0, 1.0), (2, 1499.0, 15.0), (3, 1500.0, None), (4, 2500.0, 1.0), (5, -1.0, 1.0)],
        "id int, DR1TKCAL double, DR1TPROT double",
    )
    out = feat.dietary_features(df)
    assert column(out, "protein_pct_calories")[:4] == [None, 400.0, 4.0, None]
    assert column(out, "protein_pct_calories")[5] is None
    assert column(out, "low_calorie") == [0, 1, 1, 0, 0, 1]
    assert column(out, "normal_calorie") == [0, 0, 0, 1, 0, 0]
    assert column(out, "high_calorie") == [0, 0, 0, 0, 1, 0]
    assert "fat_pct_calories" not in out.columns
    protein_only = df.drop("DR1TKCAL")
    assert feat.dietary_features(protein_only).columns == protein_only.columns


def test_polynomial_order(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "age_squared double, bmi_squared double, mean_specific_ige double")
    out = feat.polynomial_features(df).first()
    assert [out[f"poly_{i}"] for i in range(9)] == [2.0, 3.0, 5.0, 4.0, 6.0, 10.0, 9.0, 15.0, 25.0]
    assert "poly_9" in feat.polynomial_features(df, degree=3).columns
    assert "poly_10" not in feat.polynomial_features(df, degree=3).columns
    assert feat.polynomial_features(df, degree=1).columns == df.columns


def test_interactions(spark):
    df = spark.createDataFrame(
        [(40.0, 25.0, math.e - 1, 3, 1, 2)],
        "Age_years double, BMI double, Total_IgE double, total_sensitizations int, high_pollen_season int, outdoor_sensitizations int",
    )
    out = feat.interaction_features(df).first()
    assert out["age_ige_interaction"] == pytest.approx(40.0)
    assert out["bmi_ige_interaction"] == pytest.approx(25.0)
    assert out["age_sensitization_interaction"] == 120.0
    assert out["season_outdoor_interaction"] == 2


def test_logarithm_of_extremes(spark):
    values = [math.inf, -math.inf, math.nan, 1e10, -1e10]
    df = nan_as_null(numbered(spark, "LBXIGE", values))
    out = column(feat.log_features(df), "log_total_ige")
    assert out[0] == math.inf and out[1] is None and out[2] is None and out[4] is None
    assert out[3] == pytest.approx(23.02585, abs=1e-4)


def test_targets(spark):
    totals = [None, -1.0, 0.0, 86.99, 87.0, 100.0, 100.01, 180.0, 400.0]
    out = target_features(numbered(spark, "Total_IgE", totals))
    assert column(out, "ige_class") == [
        "Unknown", "Very_High", "Normal", "Normal", "Borderline", "Borderline", "Borderline", "Elevated", "Very_High",
    ]
    assert column(out, "elevated_ige") == [0, 0, 0, 0, 0, 0, 1, 1, 1]
    counts = numbered(spark, "total_sensitizations", [0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 6.0, 101.0])
    assert column(target_features(counts), "sensitization_severity") == [
        "none", "mild", "mild", "mild", "moderate", "moderate", "severe", None,
    ]


def test_safe_divide(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, None, 2.0), (2, 3.0, None), (3, 3.0, 2.0)], "id int, a double, b double")
    assert column(df.withColumn("q", safe_divide(F.col("a"), F.col("b"), -9)), "q") == [-9.0, -9.0, -9.0, 1.5]


def test_unknown_columns_are_left_alone(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "unexpected_column int")
    for step in (
        sensitization_features, feat.demographic_features, panel_statistics, panel_ratios, feat.seasonal_features,
        feat.body_features, feat.dietary_features, feat.interaction_features, feat.polynomial_features,
        feat.log_features, target_features,
    ):
        assert step(df).columns == df.columns


def test_row_local_steps_accept_a_stream(spark, tmp_path):
    source = spark.createDataFrame([(30.0, 1)], "RIDAGEYR double, RIAGENDR int")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = (
        feat.demographic_features(stream)
        .writeStream.format("memory")
        .queryName("demographics")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .start()
    )
    query.processAllAvailable()
    query.stop()
    assert spark.table("demographics").first()["is_male"] == 1
