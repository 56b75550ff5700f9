"""Statistics across the columns of one row, skipping missing cells.

Sums and extremes are plain expressions; only the quantiles build an array, sorted once with its
nulls first, so that everything stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_count(columns: list[str]) -> Column:
    return _total([F.col(c).isNotNull().cast("int") for c in columns])


def row_sum(columns: list[str]) -> Column:
    """Sum of the filled cells; 0 when all are missing."""
    return _total([F.coalesce(F.col(c), F.lit(0)) for c in columns])


def row_mean(columns: list[str]) -> Column:
    zero = F.lit(0.0)
    filled = _total([F.coalesce(F.col(c).cast("double"), zero) for c in columns])
    return F.try_divide(filled, row_count(columns).cast("double"))


def row_std(columns: list[str], mean: Column) -> Column:
    """Sample standard deviation about a mean already computed; null below two cells."""
    n = row_count(columns)
    spread = _total([F.coalesce(F.pow(F.col(c) - mean, F.lit(2)), F.lit(0.0)) for c in columns])
    return F.when(n > 1, F.sqrt(spread / (n - 1)))


def row_max(columns: list[str]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def row_min(columns: list[str]) -> Column:
    return F.least(*columns) if len(columns) > 1 else F.col(columns[0])


def sorted_cells(columns: list[str]) -> Column:
    return F.sort_array(F.array(*[F.col(c).cast("double") for c in columns]), asc=True)


def sorted_quantile(cells: Column, width: int, filled: Column, p: float) -> Column:
    """Linear-interpolated quantile of an array that holds its nulls first."""
    place = (filled - 1) * F.lit(p)
    skip = F.lit(width) - filled
    low = F.get(cells, (skip + F.floor(place)).cast("int"))
    high = F.get(cells, (skip + F.ceil(place)).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def with_row_quantiles(df: DataFrame, columns: list[str], named: dict[str, float]) -> DataFrame:
    """Add one quantile column per entry of ``named``; the sorted array exists for one projection."""
    keep = df.columns
    helper = df.select("*", sorted_cells(columns).alias("__cells"), row_count(columns).alias("__filled"))
    return helper.select(
        *keep,
        *[
            sorted_quantile(F.col("__cells"), len(columns), F.col("__filled"), p).alias(name)
            for name, p in named.items()
        ],
    )
