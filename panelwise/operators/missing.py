"""Missing values: profile, imputation; and narrowing of column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.columns import numeric_columns, string_columns
from panelwise.operators.ranking import exact_quantiles
from panelwise.vocabulary import ID_COLUMNS


def missing_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and null percentage per column; one pass, one row of partial counts per task."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_missing"))
            for i, c in enumerate(df.columns)
        ]
    )
    long = counts.select("n_rows", F.explode(cells).alias("cell")).select("cell.*", "n_rows")
    share = F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")) * 100.0
    return long.select("column", "n_missing", "n_rows", share.alias("missing_pct"))


def above_missing(profile: DataFrame, share: float) -> DataFrame:
    """Columns whose null percentage is strictly above ``share``."""
    return profile.where(F.col("missing_pct") > F.lit(share * 100.0))


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per string column, the smallest on ties; None when all are null.

    Counts per (column, value) are partially aggregated before the shuffle, then one smallest
    (-count, value) is kept per column: no task holds all values of a column.
    """
    columns = list(columns)
    if not columns:
        return {}
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    )
    counted = (
        df.select(F.explode(cells).alias("cell"))
        .where(F.col("cell.value").isNotNull())
        .groupBy("cell.column", "cell.value")
        .count()
    )
    best = counted.groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("best")
    )
    modes = dict.fromkeys(columns)
    modes.update({r["column"]: r["best"]["value"] for r in best.collect()})
    return modes


def fill_values(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> dict[str, float | str]:
    """What missing cells are filled with, for each column that has any."""
    numeric, text = numeric_columns(df, ids), string_columns(df, ids)
    gaps = _with_nulls(df, numeric + text)
    fills: dict[str, float | str] = {
        c: m for c, m in column_medians(df, [c for c in numeric if c in gaps]).items() if m is not None
    }
    for c, mode in column_modes(df, [c for c in text if c in gaps]).items():
        fills[c] = "unknown" if mode is None else mode
    return fills


def _with_nulls(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """The columns that have a missing cell: only they need the costly statistics."""
    if not columns:
        return set()
    row = df.agg(*[F.bool_or(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if row[f"g{i}"]}


def impute(
    df: DataFrame,
    ids: Sequence[str] = ID_COLUMNS,
    fills: dict[str, float | str] | None = None,
) -> DataFrame:
    """Numeric columns become DOUBLE and get their exact median, string columns their mode.

    A numeric column without any value stays null. Filling is a projection over literals.
    """
    fills = fill_values(df, ids) if fills is None else fills
    numeric = set(numeric_columns(df, ids))

    def filled(c: str):
        value = F.col(c).cast("double") if c in numeric else F.col(c)
        return F.coalesce(value, F.lit(fills[c])).alias(c) if c in fills else value.alias(c)

    return df.select(*[filled(c) for c in df.columns])


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def narrowing_plan(
    df: DataFrame, whole_limit: int = 10_000, float_type: str = "float"
) -> DataFrame:
    """For each column its type, its range, and the narrower type that holds it.

    ``as_dictionary`` marks string columns with under half as many values as rows.
    """
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, _WHOLE)]
    text = string_columns(df)
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[f(c).cast("bigint").alias(f"{n}_{c}") for c in whole for n, f in (("low", F.min), ("high", F.max))],
        *[F.count(c).alias(f"filled_{c}") for c in whole],
    )
    # Exact distinct counts by column, so that the values of all columns share one shuffle and no
    # task sees all values of a column.
    if text:
        cells = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in text]
        )
        values = df.select(F.explode(cells).alias("cell")).where(F.col("cell.value").isNotNull())
        different = {
            r["column"]: r["n"]
            for r in values.groupBy("cell.column", "cell.value")
            .agg(F.lit(1).alias("one"))
            .groupBy("column")
            .agg(F.count("one").alias("n"))
            .collect()
        }
    else:
        different = {}
    row = stats.first()
    records = []
    for f in df.schema.fields:
        c, old = f.name, f.dataType.simpleString()
        low = high = n_values = None
        new, dictionary = old, 0
        if c in whole:
            low, high = row[f"low_{c}"], row[f"high_{c}"]
            new = _whole_type(low, high, whole_limit) or old
        elif isinstance(f.dataType, T.DoubleType):
            new = float_type
        elif c in text:
            n_values = different.get(c, 0)
            dictionary = int(row["n_rows"] > 0 and n_values / row["n_rows"] < 0.5)
        records.append((c, old, new, low, high, n_values, dictionary))
    return df.sparkSession.createDataFrame(
        records,
        "column string, old_type string, new_type string, low bigint, high bigint, "
        "n_values bigint, as_dictionary int",
    )


def _whole_type(low: int | None, high: int | None, limit: int) -> str | None:
    """Smallest signed Spark type that covers the range the rules allow; None to leave it."""
    if low is None:
        return None
    if low >= 0:
        rules = ((high < 255, "smallint"), (high < 65_535, "int"), (high < limit, "bigint"))
    else:
        rules = (
            (low > -128 and high < 127, "tinyint"),
            (low > -32_768 and high < 32_767, "smallint"),
            (abs(low) < limit and high < limit, "int"),
        )
    return next((name for ok, name in rules if ok), None)


def narrow_types(df: DataFrame, whole_limit: int = 10_000, float_type: str = "float") -> DataFrame:
    """Apply the narrowing plan; strings stay strings (Parquet encodes dictionaries itself)."""
    plan = narrowing_plan(df.select(*[c for c in df.columns if c not in string_columns(df)]), whole_limit, float_type)
    casts = {r["column"]: r["new_type"] for r in plan.collect()}
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])
