"""Checks, profiles, fingerprints and chunked work on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.operators.missing import above_missing, missing_profile
from panelwise.operators.ranking import dense_index
from panelwise.options import DEFAULT, Thresholds
from panelwise.schemas import TrialTable


class EmptyTableError(ValueError):
    """A source has no rows."""


def type_histogram(df: DataFrame) -> dict[str, int]:
    """Number of columns per type; needs no job."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return counts


def validate_source(df: DataFrame, name: str, opts: Thresholds = DEFAULT) -> DataFrame:
    """Columns with too many nulls; an empty table is an error."""
    if df.isEmpty():
        raise EmptyTableError(f"{name} has no rows")
    return above_missing(missing_profile(df), opts.missing_share)


def meets_requirements(df: DataFrame, columns: Sequence[str], min_rows: int = 1) -> bool:
    """Are the columns there, and at least ``min_rows`` rows? Reads no more rows than that."""
    if not set(columns) <= set(df.columns):
        return False
    return df.limit(min_rows).count() >= min_rows


def table_profile(df: DataFrame, notable_pct: float = 5.0) -> DataFrame:
    """Per column: type, rows, nulls, rounded null percentage, and whether it is notable."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    rounded = F.round("missing_pct", 2)
    return missing_profile(df).select(
        "column",
        types[F.col("column")].alias("type"),
        "n_rows",
        "n_missing",
        rounded.alias("missing_pct"),
        (rounded > notable_pct).cast("int").alias("notable"),
    )


def constraint_checks(tables: dict[str, DataFrame], rules: dict[str, TrialTable]) -> DataFrame:
    """Violations of each declared rule: (table, rule, column, violations).

    Keys: rows beyond the first of each key. Required columns: nulls. Parents: rows whose value is
    in no parent row. A key's counts are partially aggregated; a parent is looked up once per
    different child value, so a value held by many child rows does not make one task heavy.
    """
    parts = []
    for name, rule in rules.items():
        if name not in tables:
            continue
        df = tables[name]
        keyed = df.groupBy(*rule.key).agg(F.count("*").alias("n"))
        extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint")
        parts.append(_violations(keyed.agg(extra.alias("violations")), name, "primary_key", ",".join(rule.key)))
        if rule.required:
            nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rule.required])
            cells = F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).alias("violations"))
                    for c in rule.required
                ]
            )
            parts.append(
                nulls.select(F.explode(cells).alias("v")).select(
                    F.lit(name).alias("table"),
                    F.lit("not_null").alias("rule"),
                    "v.column",
                    F.col("v.violations").cast("bigint").alias("violations"),
                )
            )
        for column, parent in rule.parents.items():
            if parent not in tables:
                continue
            children = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
            target = rules[parent].key[0]
            known = tables[parent].select(F.col(target).alias(column)).distinct()
            orphans = children.join(known, column, "left_anti")
            total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")
            parts.append(_violations(orphans.agg(total), name, "foreign_key", column))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _violations(one_row: DataFrame, table: str, rule: str, column: str) -> DataFrame:
    return one_row.select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), "violations"
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Sixteen hex digits from the schema and all rows, whatever their order.

    Every row counts once: a hash per row, combined by sum and exclusive or, in one pass.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    schema = ";".join(f"{c}:{t}" for c, t in df.dtypes)
    mixed = F.concat_ws(
        "|", F.lit(schema), F.col("n_rows"), F.col("mixed"), F.col("summed")
    )
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(row_hash).alias("mixed"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("summed"),
    ).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.substring(F.md5(mixed), 1, 16).alias("fingerprint")
    )


def map_chunks(
    df: DataFrame,
    apply: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply a function to chunks of rows in parallel, for work that has no column expression."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield apply(batch)

    return df.mapInPandas(run, schema)


def map_columns(df: DataFrame, reduce_column: Callable[[Column], Column], columns: Sequence[str]) -> DataFrame:
    """Apply an aggregate to each column, all in one pass: (column, value)."""
    row = df.agg(*[reduce_column(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)]
    )
    return row.select(F.explode(cells).alias("cell")).select("cell.*")


def with_chunks(df: DataFrame, key: str, size: int = 10_000, out: str = "chunk") -> DataFrame:
    """Chunk number of each row: ``size`` consecutive rows in key order share one."""
    indexed, _ = dense_index(df, key, "__row")
    return indexed.select(*df.columns, F.floor(F.col("__row") / F.lit(size)).alias(out))
