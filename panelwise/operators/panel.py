"""Laboratory panels: long results to wide rows, code names, flags and row statistics.

Every step takes the panel columns as an argument; ``panel_columns`` finds them by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import first_present, flag, present
from panelwise.functions.rowstats import (
    row_max,
    row_mean,
    row_min,
    row_std,
    row_sum,
    with_row_quantiles,
)
from panelwise.options import DEFAULT, Thresholds
from panelwise.vocabulary import ANALYTE_GROUPS, ANALYTES, CODE_NAMES, TOTAL_NAMES


def rename_codes(df: DataFrame, names: dict[str, str] = CODE_NAMES) -> DataFrame:
    """Give survey codes their names; codes that are not columns are ignored."""
    return df.withColumnsRenamed(names)


def panel_columns(df: DataFrame, with_total: bool = False) -> list[str]:
    """Columns that hold a laboratory value, found by name."""
    found = [c for c in df.columns if c.startswith("LBX") or "IgE" in c or c in ANALYTES]
    return found if with_total else [c for c in found if c not in TOTAL_NAMES]


def columns_with_stem(df: DataFrame, stems: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(stem in c for stem in stems)]


def pivot_panel(
    results: DataFrame,
    by: Sequence[str | Column],
    analyte: str,
    value: str,
    analytes: Sequence[str],
    total: str | None = None,
) -> DataFrame:
    """Long results to one row per ``by``, one averaged column per analyte.

    The analyte values are given, so no job looks them up. The averages are conditional
    aggregates: they are partially computed before the shuffle, so a key that holds a large share
    of the results sends one row per task.
    """
    cell = F.col(value)
    columns = [F.avg(F.when(F.col(analyte) == F.lit(a), cell)).alias(a) for a in analytes]
    if total is not None:
        columns.append(F.sum(cell).alias(total))
    return results.groupBy(*by).agg(*columns)


def sensitization_features(
    df: DataFrame,
    panel: Sequence[str] | None = None,
    groups: dict[str, Sequence[str]] = ANALYTE_GROUPS,
    opts: Thresholds = DEFAULT,
) -> DataFrame:
    """Per-analyte flags (missing stays missing), their count, and counts per analyte group."""
    panel = panel_columns(df) if panel is None else present(df, panel)
    if not panel:
        return df
    flags = {c: f"{c}_sensitized" for c in panel}
    flagged = df.select(
        "*", *[(F.col(c) >= F.lit(opts.sensitized_at)).cast("int").alias(f) for c, f in flags.items()]
    )
    counted = flagged.select("*", row_sum(list(flags.values())).alias("total_sensitizations"))
    total = F.col("total_sensitizations")
    columns = [
        (total > 0).cast("int").alias("any_sensitization"),
        (total >= opts.poly_count).cast("int").alias("poly_sensitized"),
    ]
    for group, members in groups.items():
        member_flags = [flags[m] for m in members if m in flags]
        if member_flags:
            count = row_sum(member_flags)
            columns += [
                count.alias(f"{group}_sensitizations"),
                (count > 0).cast("int").alias(f"any_{group}_sensitization"),
            ]
    return counted.select("*", *columns)


def panel_statistics(df: DataFrame, panel: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, extremes, spread and quartiles of the filled cells of each row."""
    panel = panel_columns(df) if panel is None else present(df, panel)
    if not panel:
        return df
    keep = df.columns
    ranked = with_row_quantiles(
        df.select("*", row_mean(panel).alias("mean_specific_ige")),
        panel,
        {"median_specific_ige": 0.5, "ige_25percentile": 0.25, "ige_75percentile": 0.75},
    )
    return ranked.select(
        *keep,
        "mean_specific_ige",
        "median_specific_ige",
        row_max(panel).alias("max_specific_ige"),
        row_min(panel).alias("min_specific_ige"),
        row_std(panel, F.col("mean_specific_ige")).alias("std_specific_ige"),
        "ige_25percentile",
        "ige_75percentile",
        (F.col("ige_75percentile") - F.col("ige_25percentile")).alias("ige_iqr"),
    )


def panel_ratios(df: DataFrame, total: str | None = None) -> DataFrame:
    """Mean and maximum relative to the total; null where the total is missing or zero."""
    total = total or first_present(df, *TOTAL_NAMES)
    if total is None or "mean_specific_ige" not in df.columns:
        return df
    return df.select(
        "*",
        F.try_divide("mean_specific_ige", total).alias("specific_to_total_ratio"),
        F.try_divide("max_specific_ige", total).alias("max_specific_to_total_ratio"),
    )


def elevated(total: Column, opts: Thresholds = DEFAULT) -> Column:
    return flag(total > F.lit(opts.elevated_total))
