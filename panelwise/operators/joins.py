"""Left joins that keep every base row, spread heavy keys, and the random-assignment join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import present
from panelwise.functions.hashing import as_key, pick
from panelwise.operators.ranking import dense_index
from panelwise.vocabulary import KEY, TRIAL_FEATURES

HEAVY_ROWS = 2_000_000
HEAVY_SHARE = 0.001
SALTS = 64


def heavy_keys(df: DataFrame, key: str, min_rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> list:
    """Keys with at least ``share`` of the rows (None if nulls have it), from one pass with a
    bounded sketch per task.

    Only balance depends on the estimate, never a result. At most 1/share keys can qualify.
    """
    row = df.select(F.col(key).alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("k").alias("filled"),
        F.expr("approx_top_k(k, 200, 20000)").alias("top"),
    ).first()
    if row["n"] < min_rows:
        return []
    limit = share * row["n"]
    heavy = [i["item"] for i in row["top"] or [] if i["item"] is not None and i["count"] >= limit]
    return heavy + ([None] if row["n"] - row["filled"] >= limit else [])


def spread_left_join(
    left: DataFrame, right: DataFrame, key: str, heavy: Sequence, salts: int = SALTS
) -> DataFrame:
    """Left join in which each heavy key is cut into ``salts`` parts.

    Left rows of a heavy key get a part number from their content; its right rows are repeated
    once per part. Other keys have one part, so nothing else grows. Null keys match nothing, so
    their left rows are only spread.
    """
    if not heavy:
        return left.join(right, key, "left")
    values = [k for k in heavy if k is not None]
    is_heavy = F.col(key).isin(values) if values else F.lit(False)
    part = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    cut = left.select("*", F.when(F.col(key).isNull() | is_heavy, part).otherwise(F.lit(0)).alias("__part"))
    parts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.select("*", F.explode(parts).alias("__part"))
    return cut.join(repeated, [key, "__part"], "left").drop("__part")


def left_join_chain(
    base: DataFrame,
    others: Sequence[DataFrame],
    key: str = KEY,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Base left-joined to each table in turn on one key.

    A table first loses the columns that are there already: the first table that has a column
    wins. Repeated keys on the right repeat base rows. ``heavy=None`` looks for heavy base keys
    first; all joins of the chain share the key, so that is one pass.
    """
    if heavy is None:
        heavy = heavy_keys(base.select(key), key)

    def attach(done: DataFrame, table: DataFrame) -> DataFrame:
        if key not in table.columns or key not in done.columns:
            return done
        shared = [c for c in table.columns if c in set(done.columns) and c != key]
        return spread_left_join(done, table.drop(*shared), key, heavy)

    return reduce(attach, others, base)


def survey_join(tables: dict[str, DataFrame], key: str = KEY, heavy: Sequence | None = None) -> DataFrame:
    """Join survey components by name: the laboratory table first, else the first demographic
    table, else the first table; the others follow in the given order."""
    names = list(tables)
    base = next((n for n in names if n == "AL_IGE_D"), None)
    base = base or next((n for n in names if "DEMO" in n), names[0])
    return left_join_chain(tables[base], [tables[n] for n in names if n != base], key, heavy)


def subject_table(
    subjects: DataFrame,
    exposures: DataFrame | None = None,
    lab_panel: DataFrame | None = None,
    key: str = "subject_accession",
    heavy: Sequence | None = None,
) -> DataFrame:
    """Subjects with their exposures and their laboratory panel (one row per subject), where given."""
    return left_join_chain(subjects, [t for t in (exposures, lab_panel) if t is not None], key, heavy)


def union_studies(studies: dict[str, DataFrame], tag: str = "study") -> DataFrame:
    """Rows of all studies under a tag column; columns a study lacks are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in studies.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def random_assignment_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    features: Sequence[str] = TRIAL_FEATURES,
    prefix: str = "immport_",
    salt: int = 0,
    chosen: Column | None = None,
) -> DataFrame:
    """Every left row gets the listed columns of one right row, drawn uniformly with replacement.

    The draw depends on the left key alone. Right rows are numbered in key order and matched on
    the number: an equi-join over evenly spread numbers.
    """
    features = present(right, features)
    if not features:
        return left
    numbered, n = dense_index(right.select(right_key, *features), right_key, "__draw")
    if n == 0:
        return left
    text = dict(left.dtypes)[left_key] == "string"
    draw = chosen if chosen is not None else pick(as_key(F.col(left_key), text), n, salt)
    renamed = numbered.select("__draw", *[F.col(f).alias(f"{prefix}{f}") for f in features])
    return left.withColumn("__draw", draw).join(renamed, "__draw", "left").drop("__draw")
