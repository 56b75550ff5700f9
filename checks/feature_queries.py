"""Panel and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.roles import (
    ANALYTES,
    GROUPS,
    LIMITS,
    PANEL_SQL,
    SUBJECT_SQL,
    SURVEY_SQL,
    Tables,
    flag_sql,
    panel,
    query,
    r6,
    subject,
    survey,
)
from panelwise.functions.columns import safe_divide
from panelwise.operators import features as feat
from panelwise.operators.panel import (
    panel_ratios,
    panel_statistics,
    rename_codes,
    sensitization_features,
)
from panelwise.operators.targets import target_features

# --------------------------------------------------------------------------------------------
# panel


@query("panel_pivot", f"WITH {PANEL_SQL} SELECT * FROM panel")
def _(t: Tables):
    return panel(t)


def flags_sql(source: str, name: str = "flagged") -> str:
    """CTEs that add the flags and counts to ``source``."""
    flags = ", ".join(f"CAST({a} >= 50.0 AS INTEGER) AS {a}_sensitized" for a in ANALYTES)

    def count(members) -> str:
        return "(" + " + ".join(f"coalesce({m}_sensitized, 0)" for m in members) + ")"

    groups = ", ".join(
        f"{count(m)} AS {g}_sensitizations, CAST({count(m)} > 0 AS INTEGER) AS any_{g}_sensitization"
        for g, m in GROUPS.items()
    )
    total = count(ANALYTES)
    return (
        f"{name}_0 AS (SELECT *, {flags} FROM {source}), "
        f"{name} AS (SELECT *, {total} AS total_sensitizations, CAST({total} > 0 AS INTEGER) AS any_sensitization, "
        f"CAST({total} >= 3 AS INTEGER) AS poly_sensitized, {groups} FROM {name}_0)"
    )


def flagged(df):
    return sensitization_features(df, ANALYTES, GROUPS, LIMITS)


@query("sensitization_flags", f"WITH {PANEL_SQL}, {flags_sql('panel')} SELECT * FROM flagged")
def _(t: Tables):
    return flagged(panel(t))


_CELLS = ", ".join(ANALYTES)
_SUM = " + ".join(f"coalesce({a}, 0)" for a in ANALYTES)
_FILLED = " + ".join(f"CAST({a} IS NOT NULL AS INTEGER)" for a in ANALYTES)


def _row_quantile(p: float) -> str:
    """Interpolated by position in the sorted list of filled cells."""
    place = f"((filled - 1) * {p})"
    low, high = f"s[CAST(floor{place} AS INTEGER) + 1]", f"s[CAST(ceil{place} AS INTEGER) + 1]"
    return f"({low} + ({high} - {low}) * ({place} - floor{place}))"


def stats_sql(source: str) -> str:
    """CTEs that end in ``stats``: the source with its row statistics, not rounded."""
    squares = " + ".join(f"coalesce(pow({a} - m, 2), 0.0)" for a in ANALYTES)
    return (
        f"stats_0 AS (SELECT *, list_sort([{_CELLS}], 'ASC', 'NULLS LAST') AS s, "
        f"{_FILLED} AS filled, ({_SUM}) / nullif({_FILLED}, 0) AS m FROM {source}), "
        f"stats AS (SELECT * EXCLUDE (s, filled, m), m AS mean_specific_ige, "
        f"{_row_quantile(0.5)} AS median_specific_ige, greatest({_CELLS}) AS max_specific_ige, "
        f"least({_CELLS}) AS min_specific_ige, "
        f"CASE WHEN filled > 1 THEN sqrt(({squares}) / (filled - 1)) END AS std_specific_ige, "
        f"{_row_quantile(0.25)} AS ige_25percentile, {_row_quantile(0.75)} AS ige_75percentile, "
        f"{_row_quantile(0.75)} - {_row_quantile(0.25)} AS ige_iqr FROM stats_0)"
    )


STATS = (
    "mean_specific_ige median_specific_ige max_specific_ige min_specific_ige std_specific_ige "
    "ige_25percentile ige_75percentile ige_iqr"
).split()
_ROUNDED_STATS = ", ".join(r6(s, s) for s in STATS)


@query(
    "panel_row_stats",
    f"WITH {PANEL_SQL}, {stats_sql('panel')} SELECT user_id, day, {_CELLS}, total, {_ROUNDED_STATS} FROM stats",
)
def _(t: Tables):
    return panel_statistics(panel(t), ANALYTES)


# A total of zero is made by hand: some rows lose theirs.
_ZEROED = "zeroed AS (SELECT * EXCLUDE (total), CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE total END AS total FROM panel)"


@query(
    "panel_ratios",
    f"""WITH {PANEL_SQL}, {_ZEROED}, {stats_sql('zeroed')} SELECT user_id, day,
    {r6('mean_specific_ige / nullif(total, 0)', 'specific_to_total_ratio')},
    {r6('max_specific_ige / nullif(total, 0)', 'max_specific_to_total_ratio')} FROM stats""",
)
def _(t: Tables):
    zeroed = panel(t).withColumn("total", F.when(F.col("user_id") % 7 == 0, 0.0).otherwise(F.col("total")))
    full = panel_ratios(panel_statistics(zeroed, ANALYTES), "total")
    return full.select("user_id", "day", "specific_to_total_ratio", "max_specific_to_total_ratio")


CLASS_SQL = (
    "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} >= 0 AND {0} < 87 THEN 'Normal' "
    "WHEN {0} >= 87 AND {0} < 180 THEN 'Borderline' WHEN {0} >= 180 AND {0} < 400 THEN 'Elevated' "
    "ELSE 'Very_High' END"
)


def class_counts(t: Tables):
    labelled = target_features(flagged(panel(t)), "total", LIMITS)
    return labelled.groupBy("ige_class", "poly_sensitized", "sensitization_severity").agg(
        F.count("*").alias("n_rows"), F.sum("total").alias("total")
    )


SEVERITY_SQL = (
    "CASE WHEN {0} <= 0 THEN 'none' WHEN {0} <= 2 THEN 'mild' WHEN {0} <= 5 THEN 'moderate' "
    "WHEN {0} <= 100 THEN 'severe' END"
)

query(
    "panel_class_counts",
    f"""WITH {PANEL_SQL}, {flags_sql('panel')} SELECT {CLASS_SQL.format('total')} AS ige_class,
    poly_sensitized, {SEVERITY_SQL.format('total_sensitizations')} AS sensitization_severity,
    count(*) AS n_rows, {r6('sum(total)', 'total')} FROM flagged GROUP BY 1, 2, 3""",
)(class_counts)


# --------------------------------------------------------------------------------------------
# row-local features

AGE_GROUP_SQL = (
    "CASE WHEN {0} <= 0 THEN NULL WHEN {0} <= 6 THEN 'preschool' WHEN {0} <= 12 THEN 'school_age' "
    "WHEN {0} <= 18 THEN 'adolescent' WHEN {0} <= 40 THEN 'young_adult' "
    "WHEN {0} <= 60 THEN 'middle_age' WHEN {0} <= 100 THEN 'elderly' END"
)


def demographic_sql(age: str, gender: str, income: str, education: str) -> str:
    flags = {
        "is_child": f"{age} < 18",
        "is_elderly": f"{age} >= 65",
        "is_male": f"{gender} = 1",
        "is_female": f"{gender} = 2",
        "low_income": f"{income} < 1.3",
        "middle_income": f"{income} >= 1.3 AND {income} < 3.5",
        "high_income": f"{income} >= 3.5",
        "less_than_high_school": f"{education} < 3",
        "high_school": f"{education} = 3",
        "some_college": f"{education} = 4",
        "college_graduate": f"{education} = 5",
    }
    return (
        f"{AGE_GROUP_SQL.format(age)} AS age_group, {age} * {age} AS age_squared, "
        f"{age} * {age} * {age} AS age_cubed, "
        + ", ".join(f"{flag_sql(c)} AS {n}" for n, c in flags.items())
    )


@query(
    "demographic_features",
    f"""WITH {SUBJECT_SQL} SELECT user_id, age, gender, {r6('income', 'income')}, education,
    {demographic_sql('age', 'gender', 'income', 'education')} FROM subject""",
)
def _(t: Tables):
    columns = subject(t).select("user_id", "age", "gender", "income", "education")
    return feat.demographic_features(columns, "age", "gender", "income", "education")


SEASON_SQL = (
    "CASE WHEN {0} IN (12, 1, 2) THEN 'winter' WHEN {0} IN (3, 4, 5) THEN 'spring' "
    "WHEN {0} IN (6, 7, 8) THEN 'summer' WHEN {0} IN (9, 10, 11) THEN 'fall' END"
)


def seasonal_sql(month: str) -> str:
    season = SEASON_SQL.format(month)
    dummies = ", ".join(
        f"{flag_sql(f'({season}) = {chr(39)}{s}{chr(39)}')} AS season_{s}" for s in ("fall", "spring", "summer", "winter")
    )
    return (
        f"{season} AS season, {dummies}, {flag_sql(f'{month} IN (3, 4, 5, 9)')} AS high_pollen_season, "
        f"sin(2 * pi() * {month} / 12.0) AS month_sin, cos(2 * pi() * {month} / 12.0) AS month_cos"
    )


_MONTHS = (
    "months AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END "
    "AS interview_month FROM orders)"
)


@query(
    "seasonal_features",
    f"""WITH {_MONTHS}, s AS (SELECT *, {seasonal_sql('interview_month')} FROM months)
    SELECT * REPLACE (round(month_sin, 6) + 0.0 AS month_sin, round(month_cos, 6) + 0.0 AS month_cos) FROM s""",
)
def _(t: Tables):
    month = F.when(F.col("o_orderkey") % 19 != 0, F.month("o_orderdate"))
    return feat.seasonal_features(t.orders.select("o_orderkey", month.alias("interview_month")))


_BODY = {
    "underweight": "{0} < 18.5",
    "normal_weight": "{0} >= 18.5 AND {0} < 25",
    "overweight": "{0} >= 25 AND {0} < 30",
    "obese": "{0} >= 30",
}


def body_sql(bmi: str) -> str:
    flags = ", ".join(f"{flag_sql(c.format(bmi))} AS {n}" for n, c in _BODY.items())
    return f"{flags}, {bmi} * {bmi} AS bmi_squared"


@query(
    "body_features",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {body_sql('l_quantity')},
    {r6('CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount ELSE 0.0 END', 'height_weight_ratio')}
    FROM lineitem""",
)
def _(t: Tables):
    columns = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    full = feat.body_features(columns, "l_quantity", "l_extendedprice", "l_discount")
    return full.drop("l_extendedprice", "l_discount")


_ENERGY = "(l_extendedprice / 10.0)"


@query(
    "dietary_features",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
    {r6(f'l_quantity * 4.0 / ({_ENERGY} + 1) * 100', 'protein_pct_calories')},
    {r6(f'l_quantity * 9.0 / ({_ENERGY} + 1) * 100', 'fat_pct_calories')},
    {r6(f'l_quantity * 4.0 / ({_ENERGY} + 1) * 100', 'carb_pct_calories')},
    {flag_sql(f'{_ENERGY} < 1500')} AS low_calorie,
    {flag_sql(f'{_ENERGY} >= 1500 AND {_ENERGY} < 2500')} AS normal_calorie,
    {flag_sql(f'{_ENERGY} >= 2500')} AS high_calorie FROM lineitem""",
)
def _(t: Tables):
    columns = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_extendedprice") / 10.0).alias("energy")
    )
    grams = dict.fromkeys(("protein", "fat", "carb"), "l_quantity")
    return feat.dietary_features(columns, "energy", grams).drop("energy", "l_quantity")


def _derived(t: Tables):
    """Survey with flags, statistics, season and squares: the input of the products."""
    df = panel_statistics(flagged(survey(t)), ANALYTES)
    df = feat.demographic_features(df)
    return feat.body_features(feat.seasonal_features(df))


_PRODUCTS_SQL = f"{SURVEY_SQL}, {flags_sql('survey')}, {stats_sql('flagged')}"
_POLLEN = flag_sql("interview_month IN (3, 4, 5, 9)")

INTERACTIONS = {
    "age_ige_interaction": '"Age_years" * ln(1 + "Total_IgE")',
    "age_sensitization_interaction": '"Age_years" * total_sensitizations',
    "bmi_ige_interaction": '"BMI" * ln(1 + "Total_IgE")',
}


@query(
    "interaction_features",
    f"""WITH {_PRODUCTS_SQL} SELECT SEQN, {', '.join(r6(v, k) for k, v in INTERACTIONS.items())},
    CAST({_POLLEN} * outdoor_sensitizations AS INTEGER) AS season_outdoor_interaction FROM stats""",
)
def _(t: Tables):
    names = [*INTERACTIONS, "season_outdoor_interaction"]
    return feat.interaction_features(_derived(t)).select("SEQN", *names)


_A, _B, _C = '"Age_years" * "Age_years"', '"BMI" * "BMI"', "mean_specific_ige"
POLYNOMIAL = [_A, _B, _C] + [
    f"({x}) * ({y})" for x, y in ((_A, _A), (_A, _B), (_A, _C), (_B, _B), (_B, _C), (_C, _C))
]


@query(
    "polynomial_features",
    f"""WITH {_PRODUCTS_SQL} SELECT SEQN,
    {', '.join(r6(p, f'poly_{i}') for i, p in enumerate(POLYNOMIAL))} FROM stats""",
)
def _(t: Tables):
    full = feat.polynomial_features(_derived(t))
    return full.select("SEQN", *[f"poly_{i}" for i in range(len(POLYNOMIAL))])


@query(
    "log_features",
    f"""WITH {SURVEY_SQL} SELECT SEQN, {r6('ln(1 + "Total_IgE")', 'log_total_ige')},
    {', '.join(r6(f'ln(1 + {a})', f'log_{a}') for a in ANALYTES)} FROM survey""",
)
def _(t: Tables):
    full = feat.log_features(survey(t), ANALYTES)
    return full.select("SEQN", "log_total_ige", *[f"log_{a}" for a in ANALYTES])


@query(
    "target_labels",
    f"""WITH {SURVEY_SQL}, {flags_sql('survey')}, shifted AS (SELECT * EXCLUDE ("Total_IgE"),
    CASE WHEN SEQN % 13 <> 0 THEN "Total_IgE" - 20 END AS tot FROM flagged)
    SELECT SEQN, {CLASS_SQL.format('tot')} AS ige_class, {flag_sql('tot > 100')} AS elevated_ige,
    {SEVERITY_SQL.format('total_sensitizations')} AS sensitization_severity FROM shifted""",
)
def _(t: Tables):
    # shifted totals reach below zero, and some are missing
    shifted = F.when(F.col("SEQN") % 13 != 0, F.col("Total_IgE") - 20)
    full = target_features(flagged(survey(t)).withColumn("Total_IgE", shifted))
    return full.select("SEQN", "ige_class", "elevated_ige", "sensitization_severity")


@query(
    "safe_divide",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
    {r6('coalesce(l_tax / nullif(l_discount, 0), -1.0)', 'ratio')},
    {r6('coalesce(l_quantity / nullif(CASE WHEN l_linenumber > 1 THEN l_tax END, 0), 0.0)', 'per_tax')}
    FROM lineitem""",
)
def _(t: Tables):
    tax = F.when(F.col("l_linenumber") > 1, F.col("l_tax"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        safe_divide(F.col("l_tax"), F.col("l_discount"), -1.0).alias("ratio"),
        safe_divide(F.col("l_quantity"), tax).alias("per_tax"),
    )


@query(
    "rename_codes",
    f"""WITH {SUBJECT_SQL} SELECT user_id AS SEQN, age AS "Age_years", gender AS "Gender",
    {r6('income', '"Poverty_income_ratio"')}, education AS "Education_level", bmi AS "BMI" FROM subject""",
)
def _(t: Tables):
    coded = subject(t).select(
        F.col("user_id").alias("SEQN"),
        F.col("age").alias("RIDAGEYR"),
        F.col("gender").alias("RIAGENDR"),
        F.col("income").alias("INDFMPIR"),
        F.col("education").alias("DMDEDUC2"),
        F.col("bmi").alias("BMXBMI"),
    )
    return rename_codes(coded)
