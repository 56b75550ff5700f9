"""Class balance: interpolated rows for a small class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import numeric_columns, string_columns
from panelwise.functions.hashing import pick, uniform
from panelwise.operators.neighbors import nearest_neighbors
from panelwise.operators.prepare import class_counts
from panelwise.operators.ranking import dense_index
from panelwise.options import DEFAULT, Thresholds, Training
from panelwise.session import written
from panelwise.vocabulary import ID_COLUMNS, KEY

_BASE, _NEIGHBOR, _GAP, _TEXT = 101, 103, 107, 1000


def minority_class(df: DataFrame, target: str) -> tuple[object, int, float] | None:
    """(class, its rows, majority / minority); None with fewer than two classes."""
    counts = class_counts(df, target)
    if len(counts) < 2:
        return None
    value, rows = min(counts, key=lambda item: (item[1], item[0]))
    return value, rows, max(n for _, n in counts) / rows


def balance_classes(
    df: DataFrame,
    target: str = "poly_sensitized",
    key: str = KEY,
    opts: Thresholds = DEFAULT,
    training: Training = Training(),
) -> DataFrame:
    """Append interpolated rows of the smallest class when the classes are severely unbalanced.

    Appended rows have a null key. Nothing is added for one class, for a ratio up to the limit, or
    for five rows and fewer.
    """
    if target not in df.columns:
        return df
    found = minority_class(df, target)
    if found is None:
        return df
    value, rows, ratio = found
    wanted = int(rows * training.synthetic_share)
    if ratio <= opts.imbalance_ratio or wanted < 1 or rows <= 5:
        return df
    minority = written(df.where(F.col(target) == F.lit(value)), "minority")
    return df.unionByName(interpolated_rows(minority, key, wanted, training.neighbors), allowMissingColumns=True)


def interpolated_rows(minority: DataFrame, key: str, wanted: int, k: int = 5) -> DataFrame:
    """``wanted`` new rows: a random base row moved a random share of the way to one of its k
    nearest neighbours in all numeric columns; each string column is drawn on its own.

    All draws are functions of the new row's number. Joins run on evenly drawn row numbers.
    """
    numeric = numeric_columns(minority, (key, *ID_COLUMNS))
    text = string_columns(minority, (key, *ID_COLUMNS))
    cells = F.array(*[F.col(c).cast("double") for c in numeric])
    place = F.transform(cells, lambda x: F.coalesce(x, F.lit(0.0)))
    source = minority.select(
        F.col(key).cast("bigint").alias("id"), cells.alias("cells"), place.alias("place"), *text
    )
    indexed, m = dense_index(source, "id", "row_index")
    k = min(k, m - 1)
    if k < 1:
        return minority.limit(0)
    n = F.col("n")
    draws = minority.sparkSession.range(wanted).select(
        F.col("id").alias("n"),
        pick(F.col("id"), m, _BASE).alias("row_index"),
        (pick(F.col("id"), k, _NEIGHBOR) + 1).cast("int").alias("neighbor_rank"),
        uniform(F.col("id"), _GAP).alias("gap"),
    )
    bases = indexed.join(draws.select("row_index").distinct(), "row_index", "left_semi")
    near = nearest_neighbors(source, "id", "place", k, queries=bases)
    other = source.select(F.col("id").alias("neighbor"), F.col("cells").alias("other_cells"))
    moved = (
        draws.join(indexed.select("row_index", "id", "cells"), "row_index")
        .join(near.select("id", "neighbor_rank", "neighbor"), ["id", "neighbor_rank"])
        .join(other, "neighbor")
        .select(
            "n",
            F.zip_with("cells", "other_cells", lambda a, b: a + F.col("gap") * (b - a)).alias("cells"),
        )
    )
    new = moved.select("n", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(numeric)])
    if text:
        chosen = F.array(
            *[
                F.struct(F.lit(i).alias("slot"), pick(n, m, _TEXT + i).alias("row_index"))
                for i in range(len(text))
            ]
        )
        wanted_text = draws.select("n", F.explode(chosen).alias("draw")).select("n", "draw.*")
        values = wanted_text.join(indexed.select("row_index", *text), "row_index")
        drawn = values.groupBy("n").agg(
            *[F.max(F.when(F.col("slot") == i, F.col(c))).alias(c) for i, c in enumerate(text)]
        )
        new = new.join(drawn, "n")
    return new.drop("n")
