"""From a feature table to model input: columns, codes, weights, split, folds, scaling, vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import numeric_columns
from panelwise.functions.hashing import as_key, mix
from panelwise.operators.ranking import (
    bounded_rows,
    hash_block,
    hash_thresholds,
    position_in_group,
)
from panelwise.vocabulary import ID_COLUMNS, TARGET_COLUMNS

# Columns from which a target follows directly; left out on request only.
LEAKS = {
    "poly_sensitized": ("sensitiz",),
    "ige_class": ("Total_IgE", "LBXIGE", "log_total_ige", "_ige_interaction", "_to_total_ratio"),
    "log_total_ige": ("Total_IgE", "LBXIGE", "_ige_interaction", "_to_total_ratio"),
}


def feature_columns(df: DataFrame, target: str, drop_leaky: bool = False) -> list[str]:
    """Numeric columns that are neither ids nor targets."""
    names = numeric_columns(df, (target, *ID_COLUMNS, *TARGET_COLUMNS))
    if not drop_leaky:
        return names
    return [c for c in names if not any(part in c for part in LEAKS.get(target, ()))]


def class_counts(df: DataFrame, target: str) -> list[tuple[object, int]]:
    """(class, rows) of the classes present, in class order. A target has few classes."""
    rows = bounded_rows(df.where(F.col(target).isNotNull()).groupBy(target).count())
    if rows is None:
        raise ValueError(f"{target} has too many different values for a class column")
    return sorted((r[target], r["count"]) for r in rows)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows, share and balanced weight of each class: weight = rows / (classes * class rows)."""
    sizes = class_counts(df, target)
    rows, classes = sum(n for _, n in sizes), len(sizes)
    n = F.col("n_rows").cast("double")
    return (
        df.where(F.col(target).isNotNull())
        .groupBy(target)
        .agg(F.count("*").alias("n_rows"))
        .select(
            target, "n_rows", (n / F.lit(rows)).alias("share"), (F.lit(rows) / (classes * n)).alias("weight")
        )
    )


def with_class_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Balanced weight per row; 1 where only one class is present."""
    counts = class_counts(df, target)
    if len(counts) < 2:
        return df.withColumn(out, F.lit(1.0))
    rows = sum(n for _, n in counts)
    return df.withColumn(
        out, _by_class(target, {c: F.lit(rows / (len(counts) * n)) for c, n in counts})
    )


def with_label(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, list]:
    """Classes as 0.0, 1.0, ... in sorted order; also the classes."""
    classes = [c for c, _ in class_counts(df, target)]
    codes = {c: F.lit(float(i)) for i, c in enumerate(classes)}
    return df.withColumn(out, _by_class(target, codes)), classes


def _by_class(target: str, values: dict[object, Column]) -> Column:
    chain = None
    for c, value in values.items():
        test = F.col(target) == F.lit(c)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return F.lit(None).cast("double") if chain is None else chain


def _with_hash(df: DataFrame, key: str, salt: int) -> DataFrame:
    text = dict(df.dtypes)[key] == "string"
    return df.withColumn("__mixed", mix(as_key(F.col(key), text), salt))


def _in_blocks(
    df: DataFrame, group: str | None, key: str, salt: int, cuts, out: str
) -> DataFrame:
    """Cut each group, in hash order of the key, at the row counts ``cuts(rows of the group)``.

    Two or three passes of counts find the cutting rows; the cut itself is a comparison, so the
    rows are not shuffled however large a group is. Only where there are too many groups for that
    are the rows numbered.
    """
    grouped = df if group else df.withColumn("__all", F.lit(0))
    group = group or "__all"
    hashed = _with_hash(grouped, key, salt)
    rows = bounded_rows(hashed.groupBy(group).count(), 200)
    if rows is not None:
        sizes = {r[group]: r["count"] for r in rows}
        if None in sizes:
            raise ValueError(f"{group} has missing values; keep rows with a value first")
        ranks = {g: cuts(n) for g, n in sizes.items()}
        limits = hash_thresholds(hashed, group, "__mixed", key, ranks, sizes)
        return hashed.select(*df.columns, hash_block(hashed, group, "__mixed", key, limits).alias(out))
    placed = position_in_group(hashed, group, "__mixed", key, "__place")
    sizes = placed.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    joined = placed.join(sizes, F.col(group) == F.col("__g"))
    passed = [F.col("__place") > cut for cut in cuts(F.col("__n"))]
    block = sum((p.cast("int") for p in passed[1:]), passed[0].cast("int"))
    return joined.select(*df.columns, block.alias(out))


def _half_up(x):
    return F.floor(x + F.lit(0.5)) if isinstance(x, Column) else math.floor(x + 0.5)


def stratified_split(
    df: DataFrame,
    key: str,
    label: str | None = None,
    test_size: float = 0.2,
    salt: int = 42,
    out: str = "is_test",
) -> DataFrame:
    """Mark round(test_size * n) rows of each class (of the table, without a label) as test rows.

    The rows are the first in hash order of their key: the same on every run and partitioning.
    """
    blocks = _in_blocks(df, label, key, salt, lambda n: [_half_up(n * test_size)], "__block")
    return blocks.select(*df.columns, (F.col("__block") == 0).cast("int").alias(out))


def stratified_folds(
    df: DataFrame,
    key: str,
    label: str | None = None,
    folds: int = 5,
    salt: int = 42,
    out: str = "fold",
) -> DataFrame:
    """Fold 0 .. folds-1 for each row, of equal size (within one row) in every class."""

    def cuts(n):
        if isinstance(n, Column):
            return [F.ceil(n * j / folds) for j in range(1, folds)]
        return [-(-n * j // folds) for j in range(1, folds)]

    return _in_blocks(df, label, key, salt, cuts, out)


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column; a constant column has divisor 1."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        scaled = {
            c: ((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"{c}{suffix}")
            for c, m, s in zip(self.columns, self.means, self.scales)
        }
        if suffix:
            return df.select("*", *scaled.values())
        return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate for all columns."""
    row = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    scales = [row[f"s{i}"] or 1.0 for i in range(len(columns))]
    return Scaler(tuple(columns), tuple(means), tuple(scales))


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


@dataclass(frozen=True)
class ModelInput:
    """Prepared rows: ``key``, ``label``, ``features``, ``is_test`` (and ``weight`` for classes)."""

    rows: DataFrame
    features: list[str]
    classes: list | None
    scaler: Scaler | None

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("is_test") == 0)

    @property
    def test(self) -> DataFrame:
        return self.rows.where(F.col("is_test") == 1)


def model_input(
    df: DataFrame,
    target: str,
    key: str,
    classification: bool = True,
    features: Sequence[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    scale: bool = True,
    drop_leaky: bool = False,
) -> ModelInput:
    """Rows with a target, coded, split, scaled on the training rows and assembled.

    A column with no value at all cannot be used by a model and is left out.
    """
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in DataFrame")
    columns = list(features) if features is not None else feature_columns(df, target, drop_leaky)
    columns = [c for c in columns if c not in (key, target)]
    known = df.where(F.col(target).isNotNull()).select(
        key, F.col(target), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    classes = None
    if classification:
        known, classes = with_label(known, target)
    else:
        known = known.withColumn("label", F.col(target).cast("double"))
    split = stratified_split(known, key, "label" if classification else None, test_size, seed)
    train = F.col("is_test") == 0
    scaler = None
    if scale:
        scaler = fit_scaler(split.where(train), columns)
        split = scaler.apply(split)
    if classification:
        counts = dict(class_counts(split.where(train), "label"))
        total = sum(counts.values())
        weights = {c: F.lit(total / (len(counts) * n)) for c, n in counts.items()}
        split = split.withColumn("weight", F.coalesce(_by_class("label", weights), F.lit(1.0)))
    else:
        split = split.withColumn("weight", F.lit(1.0))
    rows = assemble(split, columns).select(key, "label", "weight", "is_test", "features")
    return ModelInput(rows, columns, classes, scaler)
