"""Exact order statistics without one global sort.

* ``exact_quantiles``  - quantiles of many columns: sketches narrow a bracket around each wanted
  rank, counts prove that the rank lies in it, and only the bracket's values are sorted.
* ``hash_thresholds`` / ``hash_block`` - the first r rows of each group in hash order: counts per
  hash range find the boundary range, and only that range is ordered. No row is shuffled.
* ``dense_index``      - 0, 1, 2, ... in key order: counts per key range give the offsets.
* ``totals_by_value`` - prefix sums in value order, by the same two levels.

What reaches the driver are counts per range, whose number is set here and does not grow with
the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from panelwise.functions.hashing import SPAN

SKETCH_ACCURACY = 2_000
DIRECT_CELLS = 4_000_000  # values a plain percentile aggregate may hold
DIRECT_DISTINCT = 1_000
BRACKET_ROWS = 500_000  # different values, or rows, that one task may order
MAX_STALLS = 4
RANGE_ROWS = 200_000
MAX_RANGES = 8_192
MAX_BOUNDED_ROWS = 10_000


def bounded_rows(df: DataFrame, limit: int = MAX_BOUNDED_ROWS) -> list | None:
    """The rows, if there are at most ``limit`` of them; otherwise None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_table(df: DataFrame, limit: int = MAX_BOUNDED_ROWS) -> DataFrame:
    """A broadcast copy when the table has at most ``limit`` rows, else the table itself."""
    rows = bounded_rows(df, limit)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


# --------------------------------------------------------------------------------------------
# quantiles


class _Bracket:
    """One wanted quantile of one column and what is known about where it lies."""

    def __init__(self, column: str, p: float, n: int):
        self.column, self.p = column, p
        place = (n - 1) * p
        self.low_rank, self.high_rank = math.floor(place), math.ceil(place)
        self.share = place - self.low_rank
        self.low = self.high = None
        self.below, self.inside = 0, n
        self.slack = 3.0 / SKETCH_ACCURACY
        self.proposal = None
        self.stalls = 0

    def holds(self, low, high) -> Column:
        c = F.col(self.column)
        test = c.isNotNull()
        if low is not None:
            test = test & (c >= F.lit(low))
        if high is not None:
            test = test & (c <= F.lit(high))
        return test

    def ends(self) -> list[float]:
        """Shares, within the bracket, that should enclose the wanted ranks."""
        return [
            min(1.0, max(0.0, (self.low_rank - self.below) / self.inside - self.slack)),
            min(1.0, max(0.0, (self.high_rank - self.below) / self.inside + self.slack)),
        ]

    def span(self) -> tuple:
        return self.column, self.low, self.high

    def inner(self) -> Column:
        return F.when(self.holds(self.low, self.high), F.col(self.column))

    def proof(self) -> list[Column]:
        low, high = self.proposal
        inside = self.holds(low, high)
        value = F.when(inside, F.col(self.column))
        return [
            F.count_if(F.col(self.column) < F.lit(low)),
            F.count_if(inside),
            F.approx_count_distinct(value),
        ]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, nulls skipped; None for an empty column."""
    columns = list(columns)
    if not columns:
        return {}
    tiny = df.count() * len(columns) <= DIRECT_CELLS
    if tiny:
        direct = columns
    else:
        sizes = df.agg(
            *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
            *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
        ).first()
        counts = {c: sizes[f"n{i}"] for i, c in enumerate(columns)}
        direct = [c for i, c in enumerate(columns) if sizes[f"d{i}"] <= DIRECT_DISTINCT]
    found: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if direct:
        row = df.agg(
            *[
                F.percentile(F.col(c).cast("double"), list(probabilities)).alias(f"q{i}")
                for i, c in enumerate(direct)
            ]
        ).first()
        for i, c in enumerate(direct):
            found[c] = list(row[f"q{i}"] or found[c])
    wide = [c for c in columns if c not in direct and counts[c]]
    if wide:
        cells = df.select(*[F.col(c).cast("double").alias(c) for c in wide])
        brackets = [_Bracket(c, p, counts[c]) for c in wide for p in probabilities]
        values = _select(cells, _narrow(cells, brackets))
        for i, b in enumerate(brackets):
            found[b.column][i % len(probabilities)] = values[i]
    return found


def _propose(cells: DataFrame, brackets: list[_Bracket]) -> None:
    """A narrower bracket for each, from one sketch per column and bracket."""
    spans: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        spans.setdefault(b.span(), []).append(b)
    sketches = [
        F.percentile_approx(same[0].inner(), [e for b in same for e in b.ends()], SKETCH_ACCURACY)
        for same in spans.values()
    ]
    row = cells.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
    for i, same in enumerate(spans.values()):
        for j, b in enumerate(same):
            b.proposal = (row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1])


def _narrow(cells: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Shrink every bracket until few values, or few different values, are left in it."""
    still_open = [b for b in brackets if b.inside > BRACKET_ROWS]
    while still_open:
        _propose(cells, still_open)
        checks = [column for b in still_open for column in b.proof()]
        row = cells.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first()
        remaining = []
        for i, b in enumerate(still_open):
            below, inside, different = row[3 * i : 3 * i + 3]
            if below <= b.low_rank and b.high_rank < below + inside:
                if inside == b.inside:
                    b.stalls += 1
                (b.low, b.high), b.below, b.inside = b.proposal, below, inside
                done = different <= BRACKET_ROWS  # that many counted values are left to order
            else:  # the sketch missed the rank: look wider inside the last proven bracket
                b.stalls += 1
                b.slack *= 4
                done = False
            # A bracket that does not shrink any more is ordered as it is.
            if not done and b.stalls < MAX_STALLS:
                remaining.append(b)
        still_open = remaining
    return brackets


def _select(cells: DataFrame, brackets: list[_Bracket]) -> list[float]:
    """Read the wanted ranks from the counted values of each bracket.

    A bracket of one value needs no reading. Rows outside all others are dropped first.
    """
    spread = {i: b for i, b in enumerate(brackets) if b.low is None or b.low != b.high}
    if not spread:
        return [b.low for b in brackets]
    tests = {i: b.holds(b.low, b.high) for i, b in spread.items()}
    inside = F.array(
        *[
            F.when(test, F.struct(F.lit(i).alias("slot"), F.col(spread[i].column).alias("value")))
            for i, test in tests.items()
        ]
    )
    counted = (
        cells.where(reduce(lambda a, b: a | b, tests.values()))
        .select(F.explode(inside).alias("cell"))
        .where(F.col("cell").isNotNull())
        .groupBy("cell.slot", "cell.value")
        .count()
    )
    upto = W.Window.partitionBy("slot").orderBy("value").rowsBetween(W.Window.unboundedPreceding, 0)
    ranks = cells.sparkSession.createDataFrame(
        [(i, b.low_rank - b.below, b.high_rank - b.below) for i, b in spread.items()],
        "slot int, low_rank bigint, high_rank bigint",
    )
    rows = (
        counted.select("slot", "value", F.sum("count").over(upto).alias("upto"))
        .join(F.broadcast(ranks), "slot")
        .groupBy("slot")
        .agg(
            F.min(F.when(F.col("upto") > F.col("low_rank"), F.col("value"))).alias("low"),
            F.min(F.when(F.col("upto") > F.col("high_rank"), F.col("value"))).alias("high"),
        )
        .collect()
    )
    ends = {i: (b.low, b.low) for i, b in enumerate(brackets)}
    ends.update({row["slot"]: (row["low"], row["high"]) for row in rows})
    return [
        ends[i][0] + (ends[i][1] - ends[i][0]) * b.share for i, b in enumerate(brackets)
    ]


# --------------------------------------------------------------------------------------------
# ranges of a numeric column


def range_splits(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Inner limits that cut the column into about equal ranges (approximate: only balance
    depends on them, never a result)."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(1_000, 10 * ranges)
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, accuracy)).first()
    return sorted(set(row[0] or []))


def with_range(df: DataFrame, column: str, splits: Sequence[float], out: str) -> DataFrame:
    """Number of the range a value falls in; binary search over the limits."""
    if not splits:
        return df.select("*", F.lit(0).alias(out))
    cast, place = f"__{out}_value", f"__{out}_place"
    cutter = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol=cast, outputCol=place, handleInvalid="keep"
    )
    cut = cutter.transform(df.withColumn(cast, F.col(column).cast("double")))
    return cut.select(*df.columns, F.col(place).cast("int").alias(out))


def _ranges_for(n: int) -> int:
    return min(MAX_RANGES, max(1, math.ceil(n / RANGE_ROWS)))


def dense_index(df: DataFrame, key: str, out: str = "row_index") -> tuple[DataFrame, int]:
    """Number the rows 0, 1, 2, ... in the order of a unique numeric key; also their count.

    One shuffle by key range. The ranges hold about the same number of rows, and the offset of
    each is the count of the rows before it.
    """
    n = df.count()
    splits = range_splits(df.select(key), key, _ranges_for(n))
    ranged = with_range(df, key, splits, "__range")
    place = F.row_number().over(W.Window.partitionBy("__range").orderBy(key))
    if not splits:
        return ranged.select(*df.columns, (place - 1).cast("bigint").alias(out)), n
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    offsets, total = [], 0
    for i in range(len(splits) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    start = F.get(F.lit(offsets).cast("array<bigint>"), F.col("__range"))
    return ranged.select(*df.columns, (start + place - 1).alias(out)), n


def totals_by_value(df: DataFrame, order: str, counts: dict[str, Column]) -> DataFrame:
    """One row per different value of ``order``: each count there, and ``{name}_upto`` over all
    values not greater.

    Rows of one value are partially aggregated before any shuffle, so a value that holds a third
    of the rows costs one row per task. The running sums are windows over value ranges; the sum of
    all lower ranges is added from a small table of counts.
    """
    n = df.agg(F.count(order)).first()[0]
    splits = range_splits(df.select(order), order, _ranges_for(n))
    ranged = with_range(
        df.select(F.col(order), *[c.alias(name) for name, c in counts.items()]).where(
            F.col(order).isNotNull()
        ),
        order,
        splits,
        "__range",
    )
    sums = [F.sum(name).cast("bigint").alias(name) for name in counts]
    by_value = ranged.groupBy("__range", order).agg(*sums)
    within = (
        W.Window.partitionBy("__range").orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    )
    before = {name: F.lit(0).cast("bigint") for name in counts}
    if splits:
        by_range = {r["__range"]: r for r in ranged.groupBy("__range").agg(*sums).collect()}
        for name in counts:
            offsets, total = [], 0
            for i in range(len(splits) + 1):
                offsets.append(total)
                total += by_range[i][name] if i in by_range else 0
            before[name] = F.get(F.lit(offsets).cast("array<bigint>"), F.col("__range"))
    return by_value.select(
        order,
        *counts,
        *[(F.sum(name).over(within) + before[name]).alias(f"{name}_upto") for name in counts],
    )


# --------------------------------------------------------------------------------------------
# first r rows of each group in hash order

_PARTS = 1 << 12


def hash_thresholds(
    df: DataFrame,
    group: str,
    mixed: str,
    key: str,
    ranks: dict[object, list[int]],
    sizes: dict[object, int],
) -> dict[object, list[tuple[int, object] | None]]:
    """For each group and wanted rank r, the (hash, key) of its r-th row in (hash, key) order.

    ``mixed`` is a whole number in [0, 2**32) spread evenly over the rows. Each pass counts rows
    per sub-range of the open ranges and keeps the sub-range with the wanted row, until it is small
    enough to order. Rank 0 gives None: no row is at or before it.
    """
    spark = df.sparkSession
    slots = [(g, j, r) for g, wanted in ranks.items() for j, r in enumerate(wanted)]
    state = {i: [0, SPAN, r] for i, (_, _, r) in enumerate(slots) if r > 0}
    rows = df.select(F.col(group).alias("g"), F.col(mixed).alias("u"), F.col(key).alias("k"))
    group_type = rows.schema["g"].dataType.simpleString()

    def opened(items: list[int]) -> DataFrame:
        table = spark.createDataFrame(
            [(slots[i][0], i, state[i][0], state[i][1]) for i in items],
            f"g {group_type}, slot int, start bigint, width bigint",
        )
        near = rows.join(F.broadcast(table), "g")
        return near.where((F.col("u") >= F.col("start")) & (F.col("u") < F.col("start") + F.col("width")))

    todo = [i for i in state if sizes[slots[i][0]] > BRACKET_ROWS]
    while todo:
        step = F.greatest(F.lit(1), F.floor(F.col("width") / F.lit(_PARTS)))
        part = F.floor((F.col("u") - F.col("start")) / step)
        sums = W.Window.partitionBy("slot").orderBy("part").rowsBetween(W.Window.unboundedPreceding, 0)
        cumulated = (
            opened(todo)
            .groupBy("slot", "width", part.alias("part"))
            .agg(F.count("*").alias("n"))
            .select("slot", "width", "part", "n", F.sum("n").over(sums).alias("upto"))
        )
        wanted = spark.createDataFrame([(i, state[i][2]) for i in todo], "slot int, want bigint")
        hits = (
            cumulated.join(F.broadcast(wanted), "slot")
            .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
            .collect()
        )
        unfinished = []
        for hit in hits:
            slot = state[hit["slot"]]
            size = max(1, hit["width"] // _PARTS)
            slot[0] += hit["part"] * size
            slot[1] = size
            slot[2] -= hit["upto"] - hit["n"]
            if hit["n"] > BRACKET_ROWS and size > 1:
                unfinished.append(hit["slot"])
        todo = unfinished
    result: dict[object, list] = {g: [None] * len(wanted) for g, wanted in ranks.items()}
    if state:
        final = opened(list(state))
        ordered = final.select(
            "slot",
            "u",
            "k",
            F.row_number().over(W.Window.partitionBy("slot").orderBy("u", "k")).alias("place"),
        )
        wanted = spark.createDataFrame(
            [(i, s[2]) for i, s in state.items()], "slot int, place int"
        )
        for row in ordered.join(F.broadcast(wanted), ["slot", "place"]).collect():
            g, j, _ = slots[row["slot"]]
            result[g][j] = (row["u"], row["k"])
    return result


def hash_block(
    df: DataFrame, group: str, mixed: str, key: str, limits: dict[object, list[tuple[int, object] | None]]
) -> Column:
    """How many of its group's thresholds lie strictly before a row: its block number."""
    branches = None
    here = F.struct(F.col(mixed).cast("bigint").alias("u"), F.col(key).alias("k"))
    key_type = df.schema[key].dataType
    for g, thresholds in limits.items():
        passed = F.lit(0)
        for t in thresholds:
            if t is None:
                passed = passed + F.lit(1)
            else:
                edge = F.struct(
                    F.lit(t[0]).cast("bigint").alias("u"), F.lit(t[1]).cast(key_type).alias("k")
                )
                passed = passed + (here > edge).cast("int")
        test = F.col(group).isNull() if g is None else F.col(group) == F.lit(g)
        branches = F.when(test, passed) if branches is None else branches.when(test, passed)
    return branches if branches is not None else F.lit(0)


def position_in_group(df: DataFrame, group: str, mixed: str, key: str, out: str) -> DataFrame:
    """1, 2, 3, ... within each group in (hash, key) order, for any number of groups.

    Windows run over hash ranges of a group, so a group that holds a third of all rows is spread
    over many tasks; counts of the earlier ranges are added.
    """
    n = df.count()
    ranges = _ranges_for(n)
    width = math.ceil(SPAN / ranges)
    ranged = df.select("*", F.floor(F.col(mixed) / F.lit(width)).alias("__range"))
    earlier = W.Window.partitionBy(group).orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(group, "__range")
        .agg(F.count("*").alias("__n"))
        .select(
            F.col(group).alias("__group"),
            F.col("__range").alias("__r"),
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        )
    )
    inner = W.Window.partitionBy(group, "__range").orderBy(mixed, key)
    placed = ranged.select("*", F.row_number().over(inner).alias("__place"))
    joined = placed.join(
        offsets,
        F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r")),
        "left",
    )
    return joined.select(*df.columns, (F.col("__place") + F.col("__offset")).cast("bigint").alias(out))
