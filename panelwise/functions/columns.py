"""Small builders of column expressions, and choices made from ``df.columns``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or an input is missing."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def within(value: Column, low: float | None, high: float | None) -> Column:
    """``low <= value < high``; a missing limit leaves that side open."""
    tests = []
    if low is not None:
        tests.append(value >= F.lit(low))
    if high is not None:
        tests.append(value < F.lit(high))
    condition = tests[0]
    for test in tests[1:]:
        condition = condition & test
    return condition


def band_flags(value: Column, bands: dict[str, tuple[float | None, float | None]]) -> list[Column]:
    """One 0/1 column per half-open band."""
    return [flag(within(value, *limits)).alias(name) for name, limits in bands.items()]


def upper_bins(value: Column, floor: float, steps: Iterable[tuple[str, float]]) -> Column:
    """Label of the first right-closed bin that holds the value; null outside all bins."""
    chain = F.when(value <= F.lit(floor), F.lit(None).cast("string"))
    for label, upper in steps:
        chain = chain.when(value <= F.lit(upper), F.lit(label))
    return chain


def safe_divide(numerator: Column, denominator: Column, fill: float = 0.0) -> Column:
    """Quotient, or ``fill`` where it is undefined or an input is missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(float(fill)))


def first_present(df: DataFrame, *names: str) -> str | None:
    """The first of the names that is a column."""
    have = set(df.columns)
    return next((name for name in names if name in have), None)


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [name for name in names if name in have]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def nan_as_null(df: DataFrame) -> DataFrame:
    """One missing marker: NaN becomes null. Call it once, at the source."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )
