"""Exact order statistics against plain Python, also through the paths for large data."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwise.functions.hashing import mix, pick, uniform
from panelwise.operators import ranking
from panelwise.operators.prepare import stratified_folds, stratified_split


def skewed(n, seed=1):
    rng = random.Random(seed)
    return [0.5 if rng.random() < 0.34 else rng.gauss(0, 1) if rng.random() < 0.9 else None for _ in range(n)]


@pytest.fixture
def large_paths(monkeypatch):
    """Let small data take the paths of large data."""
    monkeypatch.setattr(ranking, "DIRECT_CELLS", 10)
    monkeypatch.setattr(ranking, "DIRECT_DISTINCT", 5)
    monkeypatch.setattr(ranking, "BRACKET_ROWS", 50)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)


PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def expected(values):
    kept = [v for v in values if v is not None]
    return [float(np.quantile(kept, p)) for p in PROBABILITIES]


def test_quantiles_direct(spark):
    values = skewed(500)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ranking.exact_quantiles(df, ["x"], PROBABILITIES)["x"] == pytest.approx(expected(values))


def test_quantiles_through_brackets(spark, large_paths):
    columns = {"a": skewed(5000), "b": [float(i % 7) for i in range(5000)], "c": [float(i) for i in range(5000)], "d": [None] * 5000}
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double, c double, d double").repartition(6)
    found = ranking.exact_quantiles(df, list(columns), PROBABILITIES)
    assert found["d"] == [None] * len(PROBABILITIES)
    for c in "abc":
        assert found[c] == pytest.approx(expected(columns[c])), c


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=12, max_size=200))
def test_quantiles_of_any_values(spark, large_paths, values):
    if sum(v is not None for v in values) < 1:
        return
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ranking.exact_quantiles(df, ["x"], PROBABILITIES)["x"] == pytest.approx(expected(values))


def test_bracket_recovers_from_a_sketch_that_misses(spark, large_paths, monkeypatch):
    values = [float(i) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")

    def wrong(cells, brackets):
        for b in brackets:
            b.proposal = (5.0, 1000.0 * b.slack)

    monkeypatch.setattr(ranking, "_propose", wrong)
    assert ranking.exact_quantiles(df, ["x"], [0.5])["x"] == pytest.approx([1499.5])


def test_dense_index(spark, large_paths):
    keys = random.Random(3).sample(range(10**6), 1500)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    indexed, n = ranking.dense_index(df, "k")
    assert n == 1500
    assert [r["row_index"] for r in indexed.orderBy("k").collect()] == list(range(1500))


def test_totals_by_value(spark, large_paths):
    rng = random.Random(5)
    data = [(rng.choice([1.0, 1.0, 1.0, rng.random() * 5]), rng.randint(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(data, "s double, y int")
    out = ranking.totals_by_value(df, "s", {"n": F.lit(1), "y": F.col("y")}).orderBy("s").collect()
    assert [r["s"] for r in out] == sorted({s for s, _ in data})
    for r in out:
        assert r["n_upto"] == sum(s <= r["s"] for s, _ in data)
        assert r["y"] == sum(y for s, y in data if s == r["s"])


def split_rows(spark, n=3000):
    # one class holds two thirds of the rows
    return spark.createDataFrame([(i, 0 if i % 3 else 1 + i % 2) for i in range(n)], "id bigint, label int")


def test_split_is_exact_and_stable(spark, large_paths):
    df = split_rows(spark)
    first = {r["id"]: (r["label"], r["is_test"]) for r in stratified_split(df, "id", "label").collect()}
    again = {r["id"]: (r["label"], r["is_test"]) for r in stratified_split(df.repartition(9), "id", "label").collect()}
    assert first == again and len(first) == 3000
    for c, n in ((0, 2000), (1, 500), (2, 500)):
        assert sum(t for label, t in first.values() if label == c) == round(n * 0.2)


def test_large_path_equals_small_path(spark, monkeypatch):
    df = split_rows(spark)
    plain = {r["id"]: r["fold"] for r in stratified_folds(df, "id", "label").collect()}
    monkeypatch.setattr(ranking, "BRACKET_ROWS", 20)
    monkeypatch.setattr(ranking, "_PARTS", 8)
    assert plain == {r["id"]: r["fold"] for r in stratified_folds(df, "id", "label").collect()}
    for c, n in ((0, 2000), (1, 500), (2, 500)):
        sizes = [sum(1 for i, f in plain.items() if f == k and (i % 3 == 0) * (1 + i % 2) == c) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_many_groups_are_numbered(spark, large_paths):
    df = spark.createDataFrame([(i, i % 1200) for i in range(6000)], "id bigint, label int")
    out = stratified_split(df, "id", "label", 0.4).groupBy("label").agg(F.sum("is_test").alias("t")).collect()
    assert len(out) == 1200 and all(r["t"] == 2 for r in out)


def test_text_keys(spark):
    df = spark.createDataFrame([(f"k{i}", "ab"[i % 2]) for i in range(200)], "id string, label string")
    assert stratified_split(df, "id", "label").agg(F.sum("is_test")).first()[0] == 40


def test_hashes_are_even_and_independent(spark):
    df = spark.range(50_000).select(
        uniform(F.col("id"), 1).alias("u"),
        uniform(F.col("id"), 2).alias("v"),
        mix(F.col("id") + F.lit(1 << 40), 1).alias("m"),
        pick(F.col("id"), 10, 3).alias("p"),
    ).toPandas()
    for c in ("u", "v"):
        assert abs(df[c].mean() - 0.5) < 0.01 and df[c].between(0, 1, inclusive="left").all()
        counts = np.histogram(df[c], bins=20, range=(0, 1))[0]
        assert abs(counts - 2500).max() < 300
    assert abs(np.corrcoef(df["u"], df["v"])[0, 1]) < 0.02
    assert abs(np.corrcoef(df["u"][:-1], df["u"][1:])[0, 1]) < 0.05
    assert df["m"].between(0, (1 << 32) - 1).all()
    assert abs(df["p"].value_counts() - 5000).max() < 500
