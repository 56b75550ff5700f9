"""Joins, missing values, neighbours, balance, preparation, quality."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import balance, joins, missing, neighbors, prepare, quality
from panelwise.options import Thresholds, Training
from panelwise.schemas import TrialTable


# ---------------------------------------------------------------------------- joins


def test_first_table_wins_and_repeats_fan_out(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "SEQN int, x string")
    other = spark.createDataFrame([(1, "z", 10), (1, "z", 11), (3, "z", 12)], "SEQN int, x string, y int")
    unrelated = spark.createDataFrame([(9,)], "q int")
    out = joins.left_join_chain(base, [other, unrelated]).orderBy(F.col("SEQN").asc_nulls_last(), "y").collect()
    assert [tuple(r) for r in out] == [(1, "a", 10), (1, "a", 11), (2, "b", None), (None, "n", None)]


@pytest.mark.parametrize("heavy", [[], [7], [7, None], [None]])
def test_spread_join_equals_plain_join(spark, heavy):
    rng = random.Random(2)
    left = spark.createDataFrame(
        [(i, rng.choice([7, 7, 7, None, rng.randint(0, 20)])) for i in range(300)], "i int, k int"
    )
    right = spark.createDataFrame([(k, k * j) for k in range(15) for j in (1, 2)], "k int, w int")
    plain = left.join(right, "k", "left")
    spread = joins.spread_left_join(left, right, "k", heavy, salts=5)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, plain.collect())) == sorted(map(key, spread.select(plain.columns).collect()))


def test_heavy_keys_are_found(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("k"))
    assert joins.heavy_keys(df, "k", min_rows=1, share=0.1) == [5, None]
    assert joins.heavy_keys(df, "k") == []


def test_survey_base_is_chosen_by_name(spark):
    make = lambda *cols: spark.createDataFrame([(1, *[0] * len(cols))], ["SEQN", *cols])
    with_lab = joins.survey_join({"DEMO_D": make("d", "s"), "AL_IGE_D": make("l", "s")})
    assert with_lab.columns == ["SEQN", "l", "s", "d"]
    without = joins.survey_join({"MCQ_D": make("m"), "DEMO_E": make("d")})
    assert without.columns == ["SEQN", "d", "m"]


def test_random_assignment(spark):
    left = spark.range(2000).withColumnRenamed("id", "SEQN")
    right = spark.createDataFrame([(f"SUB{i}", i, float(i)) for i in range(10)], "subject_id string, rid int, IL4_baseline double")
    out = joins.random_assignment_join(left, right, "SEQN", "rid")
    assert out.columns == ["SEQN", "immport_IL4_baseline"]
    counts = {r[0]: r[1] for r in out.groupBy("immport_IL4_baseline").count().collect()}
    assert len(counts) == 10 and min(counts.values()) > 120
    assert out.exceptAll(joins.random_assignment_join(left.repartition(7), right, "SEQN", "rid")).isEmpty()
    assert joins.random_assignment_join(left, right.drop("IL4_baseline"), "SEQN", "rid") is left


def test_random_assignment_by_text_key(spark):
    left = spark.range(20).withColumnRenamed("id", "SEQN")
    right = spark.createDataFrame([(f"SUB{i}", float(i)) for i in range(4)], "subject_id string, IL4_baseline double")
    out = joins.random_assignment_join(left, right, "SEQN", "subject_id")
    assert out.where("immport_IL4_baseline is null").isEmpty() and out.count() == 20


def test_union_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    out = joins.union_studies({"a": a, "b": b}).orderBy("study").collect()
    assert [r.asDict() for r in out] == [{"x": 1, "study": "a", "y": None}, {"x": None, "study": "b", "y": 2}]


# ---------------------------------------------------------------------------- missing values


def test_imputation(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, "b", None), (2, None, None, "a", None), (3, 4.0, None, "a", None), (4, 10.0, None, "b", None), (5, None, None, None, None)],
        "SEQN int, x double, empty double, s string, none string",
    )
    out = missing.impute(df).orderBy("SEQN").collect()
    assert [r["x"] for r in out] == [1.0, 4.0, 4.0, 10.0, 4.0]
    assert [r["empty"] for r in out] == [None] * 5
    assert [r["s"] for r in out] == ["b", "a", "a", "b", "a"]  # the smallest of two equally frequent
    assert {r["none"] for r in out} == {"unknown"}
    assert missing.impute(df).schema["SEQN"].dataType.simpleString() == "int"


def test_profile_and_validation(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    high = quality.validate_source(df, "t").collect()
    assert [(r["column"], r["n_missing"]) for r in high] == [("b", 2)]
    assert quality.validate_source(df, "t", Thresholds(missing_share=2 / 3)).isEmpty()
    with pytest.raises(quality.EmptyTableError):
        quality.validate_source(df.limit(0), "t")
    assert quality.type_histogram(df) == {"int": 1, "string": 1}
    notable = {r["column"]: (r["missing_pct"], r["notable"]) for r in quality.table_profile(df).collect()}
    assert notable == {"a": (0.0, 0), "b": (66.67, 1)}


@pytest.mark.parametrize(
    "low, high, kind",
    [(0, 254, "smallint"), (0, 255, "int"), (0, 65534, "int"), (0, 65535, "bigint"), (-127, 126, "tinyint"),
     (-128, 1, "smallint"), (-32767, 1, "smallint"), (-32768, 9999, "bigint"), (-5, 40000, "bigint")],
)
def test_narrowing_limits(spark, low, high, kind):
    df = spark.createDataFrame([(low,), (high,)], "v bigint")
    assert missing.narrowing_plan(df).first()["new_type"] == kind
    assert sorted(r[0] for r in missing.narrow_types(df).collect()) == sorted([low, high])


def test_narrowing_of_doubles_and_strings(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a")], "d double, s string")
    plan = {r["column"]: r for r in missing.narrowing_plan(df).collect()}
    assert plan["d"]["new_type"] == "float" and plan["s"]["as_dictionary"] == 1
    assert missing.narrow_types(df).dtypes == [("d", "float"), ("s", "string")]


# ---------------------------------------------------------------------------- neighbours


def brute_force(points, k):
    ids = sorted(points)
    found = set()
    for i in ids:
        order = sorted((float(np.sqrt(((points[i] - points[j]) ** 2).sum())), j) for j in ids if j != i)
        found |= {(i, j, rank + 1) for rank, (_, j) in enumerate(order[:k])}
    return found


def clustered(n, seed, dims=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims)) + rng.integers(0, 4, size=(n, 1)) * 6.0
    points[: n // 3] = points[0]  # a third of the rows are copies
    return {int(i): np.round(p, 3) for i, p in enumerate(points)}


@pytest.mark.parametrize("block", [10_000, 60, 25])
def test_neighbors_are_exact(spark, block):
    points = clustered(240, 4)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in points.items()], "id bigint, v array<double>").repartition(5)
    got = neighbors.nearest_neighbors(df, "id", "v", 4, block_rows=block)
    assert {(r["id"], r["neighbor"], r["neighbor_rank"]) for r in got.collect()} == brute_force(points, 4)


def test_neighbors_of_some_rows(spark):
    points = clustered(150, 9)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in points.items()], "id bigint, v array<double>")
    got = neighbors.nearest_neighbors(df, "id", "v", 3, queries=df.where("id % 10 = 1"), block_rows=30)
    wanted = {t for t in brute_force(points, 3) if t[0] % 10 == 1}
    assert {(r["id"], r["neighbor"], r["neighbor_rank"]) for r in got.collect()} == wanted


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cells_that_spare_nothing_are_given_up(spark, monkeypatch, kind):
    """Without near and far, each row is sent a few times, not once for every 15 rows."""
    cut, paired = [], neighbors._paired
    monkeypatch.setattr(neighbors, "_paired", lambda *a: (cut.append(a[2:4]), paired(*a))[1])
    values = np.random.default_rng(3).normal(size=(300, 20)).round(2).astype("float32").astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(values)], f"id bigint, v array<{kind}>").repartition(4)
    got = neighbors.nearest_neighbors(df, "id", "v", 4, block_rows=15)
    assert {(r["id"], r["neighbor"], r["neighbor_rank"]) for r in got.collect()} == brute_force(dict(enumerate(values)), 4)
    assert cut == [([neighbors.FEW_BLOCKS], [neighbors.FEW_BLOCKS])]


def test_fewer_rows_than_neighbors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id bigint, v array<double>")
    got = neighbors.nearest_neighbors(df, "id", "v", 5).collect()
    assert {(r["id"], r["neighbor"]) for r in got} == {(1, 2), (2, 1)}
    assert neighbors.nearest_neighbors(df.limit(0), "id", "v", 5).isEmpty()


# ---------------------------------------------------------------------------- balance


def classes(spark, small, large):
    data = [(i, 1 if i < small else 0, float(i % 7), "ab"[i % 2]) for i in range(small + large)]
    return spark.createDataFrame(data, "SEQN bigint, poly_sensitized int, x double, s string")


@pytest.mark.parametrize(
    "small, large, added", [(6, 18, 0), (6, 19, 3), (5, 100, 0), (0, 10, 0), (9, 60, 4)]
)
def test_when_rows_are_added(spark, small, large, added):
    df = classes(spark, small, large)
    out = balance.balance_classes(df)
    assert out.count() == small + large + added
    new = out.where("SEQN is null").collect()
    assert len(new) == added
    assert all(r["poly_sensitized"] == 1 and 0 <= r["x"] <= 6 and r["s"] in "ab" for r in new)


def test_added_rows_lie_between_neighbors_and_are_stable(spark):
    df = classes(spark, 40, 200)
    minority = df.where("poly_sensitized = 1")
    first = balance.interpolated_rows(minority, "SEQN", 200)
    again = balance.interpolated_rows(minority.repartition(7), "SEQN", 200)
    assert first.exceptAll(again).isEmpty() and first.count() == 200
    assert balance.interpolated_rows(minority.limit(1), "SEQN", 5).isEmpty()


# ---------------------------------------------------------------------------- preparation


def test_weights_and_labels(spark):
    df = spark.createDataFrame([("b",), ("b",), ("b",), ("a",), (None,)], "t string")
    got = {r["t"]: (r["n_rows"], r["share"], r["weight"]) for r in prepare.class_balance(df, "t").collect()}
    assert got["a"] == (1, 0.25, 2.0) and got["b"] == (3, 0.75, pytest.approx(4 / 6))
    coded, names = prepare.with_label(df, "t")
    assert names == ["a", "b"]
    assert {(r["t"], r["label"]) for r in coded.collect()} == {("a", 0.0), ("b", 1.0), (None, None)}
    weighted = prepare.with_class_weight(df.where("t is not null"), "t")
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(4.0)
    one = prepare.with_class_weight(df.where("t = 'b'"), "t")
    assert {r["weight"] for r in one.collect()} == {1.0}


def test_model_input(spark):
    rng = random.Random(1)
    data = [(i, rng.gauss(0, 1), rng.gauss(5, 2), 5.0, i % 2, "text") for i in range(100)]
    df = spark.createDataFrame(data, "SEQN bigint, f1 double, f2 double, constant double, target int, note string")
    got = prepare.model_input(df, "target", "SEQN")
    assert got.features == ["f1", "f2", "constant"]
    assert (got.train.count(), got.test.count()) == (80, 20)
    x = np.array([r["features"].toArray() for r in got.train.collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(x.std(axis=0), [1, 1, 0])
    with pytest.raises(ValueError, match="absent"):
        prepare.model_input(df, "absent", "SEQN")


def test_targets_and_leaks_are_not_features(spark):
    columns = "SEQN bigint, x double, ige_class string, elevated_ige int, poly_sensitized int, total_sensitizations int, log_total_ige double, Total_IgE double"
    df = spark.createDataFrame([], columns)
    assert prepare.feature_columns(df, "poly_sensitized") == ["x", "total_sensitizations", "log_total_ige", "Total_IgE"]
    assert prepare.feature_columns(df, "poly_sensitized", True) == ["x", "log_total_ige", "Total_IgE"]
    assert prepare.feature_columns(df, "ige_class", True) == ["x", "total_sensitizations"]


@pytest.mark.parametrize("size", [-1, 0, 1, 1.5])
def test_bad_test_size(size):
    with pytest.raises(ValueError, match="test_size"):
        Training(test_size=size)


def test_bad_thresholds():
    with pytest.raises(ValueError, match="sensitized_at"):
        Thresholds(sensitized_at=0)
    with pytest.raises(ValueError, match="missing_share"):
        Thresholds(missing_share=1.1)


# ---------------------------------------------------------------------------- quality


def test_requirements(spark):
    df = spark.createDataFrame([(1, "a", 1.0)] * 3, "required_col1 int, required_col2 string, optional_col double")
    assert quality.meets_requirements(df, ["required_col1", "required_col2"])
    assert not quality.meets_requirements(df, ["required_col1", "missing"])
    assert not quality.meets_requirements(df, ["required_col1"], 10)


def test_constraints(spark):
    parents = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    children = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None), (None, 2)], "cid int, id int")
    rules = {
        "parents": TrialTable("parents", None, ("id",)),
        "children": TrialTable("children", None, ("cid",), ("cid", "id"), {"id": "parents"}),
    }
    got = {(r["table"], r["rule"], r["column"]): r["violations"] for r in quality.constraint_checks({"parents": parents, "children": children}, rules).collect()}
    assert got == {
        ("parents", "primary_key", "id"): 1,
        ("children", "primary_key", "cid"): 0,
        ("children", "not_null", "cid"): 1,
        ("children", "not_null", "id"): 1,
        ("children", "foreign_key", "id"): 2,
    }


def test_fingerprint(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    mark = lambda d: quality.table_fingerprint(d).first()["fingerprint"]
    assert len(mark(df)) == 16 and mark(df) == mark(df.orderBy(F.desc("id")))
    assert mark(df) != mark(df.limit(99)) and mark(df) != mark(df.withColumnRenamed("x", "y"))


def test_chunks(spark):
    df = spark.range(25).select((F.col("id") * 3).alias("k"))
    out = {r["k"] // 3: r["chunk"] for r in quality.with_chunks(df, "k", 10).collect()}
    assert out == {i: i // 10 for i in range(25)}


def test_search_by_products_is_exact():
    """Ties, copies, vectors far from the origin, fewer rows than neighbours: as by definition."""
    from panelwise.operators.neighbors import bounded_search

    r = np.random.default_rng(3)
    for shift, digits in ((0.0, 8), (1e6, 3), (0.0, 0)):
        have = (r.normal(size=(300, 12)).round(digits) + shift).round(digits)
        have[200:220] = have[0]
        ids = r.permutation(300)
        ids.sort()
        for k in (1, 5, 299, 400):
            row, place, values, full = bounded_search(ids[:60], have[:60], ids, have, k)
            for i in range(60):
                d = ((have[i] - have) ** 2).sum(axis=1)
                order = [j for j in np.lexsort((ids, d)) if j != i][:k]
                assert place[row == i].tolist() == order
                assert np.allclose(values[row == i], d[order])
            if digits == 8 and k == 5:
                assert full < 0.1 * 60 * 300
