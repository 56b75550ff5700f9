"""Joins, unions, missing values, balance, preparation, sources and quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks.feature_queries import SEASON_SQL
from checks.roles import (
    ANALYTES,
    LABELLED_SQL,
    PANEL_SQL,
    SUBJECT_SQL,
    SURVEY_SQL,
    Tables,
    labelled,
    mix_sql,
    panel,
    pick_sql,
    query,
    r6,
    subject,
    survey,
    uniform_sql,
)
from panelwise.functions.hashing import pick
from panelwise.operators import joins, missing, prepare, quality
from panelwise.operators.balance import balance_classes, interpolated_rows, minority_class
from panelwise.operators.neighbors import nearest_neighbors
from panelwise.options import Thresholds, Training
from panelwise.schemas import LAB_RESULTS, TRIAL_TABLES, TrialTable
from panelwise.session import new_table_path, written
from panelwise.sources.delimited import read_delimited, read_dump, read_with_rejects, write_dump
from panelwise.sources.folders import list_folder, move
from panelwise.sources.stages import final_report, load_optional, load_table, reuse, save_table
from panelwise.sources.studies import lab_panel, read_lab_results, read_study_table
from panelwise.sources.xport import read_xport, write_xport
from panelwise.sources.synthetic import survey_from_ids, trial_from_ids
from panelwise.vocabulary import ANALYTE_CODES

# --------------------------------------------------------------------------------------------
# joins and unions

_CHAIN_SQL = """WITH lab AS (SELECT o_orderkey AS "SEQN", o_totalprice AS amount, o_orderstatus AS status FROM orders),
  lines AS (SELECT l_orderkey AS "SEQN", l_extendedprice AS amount, l_linenumber, l_partkey FROM lineitem
    WHERE l_returnflag = 'R'),
  days AS (SELECT user_id AS "SEQN", count(*) AS n_events, 'x' AS status FROM events GROUP BY 1)
  SELECT lab."SEQN", lab.amount, lab.status, l_linenumber, l_partkey, n_events
  FROM lab LEFT JOIN lines ON lab."SEQN" = lines."SEQN" LEFT JOIN days ON lab."SEQN" = days."SEQN" """


@query("left_join_chain", _CHAIN_SQL)
def _(t: Tables):
    lab = t.orders.select(
        F.col("o_orderkey").alias("SEQN"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")
    )
    lines = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("SEQN"), F.col("l_extendedprice").alias("amount"), "l_linenumber", "l_partkey"
    )
    days = t.events.groupBy(F.col("user_id").alias("SEQN")).agg(F.count("*").alias("n_events"), F.lit("x").alias("status"))
    return joins.survey_join({"DEMO_D": lines, "AL_IGE_D": lab, "DBQ_D": days})


_SPREAD_SQL = """SELECT event_id, events.user_id, event_type, c_mktsegment AS segment
  FROM events LEFT JOIN customer ON events.user_id = c_custkey"""


@query("spread_key_join", _SPREAD_SQL)
def _(t: Tables):
    """The same left join with the ten most frequent keys cut into parts."""
    events = t.events.select("event_id", "user_id", "event_type")
    right = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    heavy = joins.heavy_keys(events, "user_id", min_rows=1, share=0.009)
    return joins.spread_left_join(events, right, "user_id", heavy, salts=8)


@query(
    "subject_exposure_join",
    f"""WITH wide AS (SELECT user_id, {', '.join(r6(f"avg(CASE WHEN event_type = '{a}' THEN value END)", a) for a in ANALYTES)}
    FROM events GROUP BY 1)
    SELECT c_custkey AS subject_accession, c_mktsegment AS segment, o_orderkey AS exposure, o_orderpriority AS process, {', '.join(ANALYTES)}
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN wide ON c_custkey = user_id""",
)
def _(t: Tables):
    from panelwise.operators.panel import pivot_panel

    subjects = t.customer.select(F.col("c_custkey").alias("subject_accession"), F.col("c_mktsegment").alias("segment"))
    exposures = t.orders.select(
        F.col("o_orderkey").alias("exposure"),
        F.col("o_custkey").alias("subject_accession"),
        F.col("o_orderpriority").alias("process"),
    )
    lab = pivot_panel(
        t.events.withColumnRenamed("user_id", "subject_accession"),
        ["subject_accession"],
        "event_type",
        "value",
        ANALYTES,
    )
    return joins.subject_table(subjects, exposures, lab)


@query(
    "random_assignment_join",
    f"""WITH pool AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_acctbal AS il4,
      s_name AS donor FROM supplier),
    drawn AS (SELECT c_custkey, {pick_sql('c_custkey', '(SELECT count(*) FROM supplier)', 5)} AS place FROM customer)
    SELECT c_custkey, il4 AS "immport_IL4_baseline", donor AS immport_donor FROM drawn LEFT JOIN pool USING (place)""",
)
def _(t: Tables):
    trial = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("IL4_baseline"), F.col("s_name").alias("donor"))
    return joins.random_assignment_join(
        t.customer.select("c_custkey"), trial, "c_custkey", "s_suppkey", ["IL4_baseline", "absent", "donor"], salt=5
    )


@query(
    "study_union",
    """SELECT c_name AS subject_id, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance,
      'customers' AS study FROM customer
    UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal, 'suppliers' FROM supplier""",
)
def _(t: Tables):
    customers = t.customer.select(
        F.col("c_name").alias("subject_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = t.supplier.select(
        F.col("s_name").alias("subject_id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return joins.union_studies({"customers": customers, "suppliers": suppliers})


# --------------------------------------------------------------------------------------------
# missing values

_PROFILED = ("user_id", "day", *ANALYTES, "total")
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM panel" for c in _PROFILED
)


@query(
    "missing_profile",
    f"""WITH {PANEL_SQL}, profile AS ({_PROFILE_SQL})
    SELECT *, {r6('100.0 * n_missing / n_rows', 'missing_pct')} FROM profile""",
)
def _(t: Tables):
    return missing.missing_profile(panel(t))


@query(
    "validate_source",
    f"""WITH {PANEL_SQL}, profile AS ({_PROFILE_SQL})
    SELECT *, {r6('100.0 * n_missing / n_rows', 'missing_pct')} FROM profile WHERE 100.0 * n_missing / n_rows > 60.0""",
)
def _(t: Tables):
    return quality.validate_source(panel(t), "panel", Thresholds(missing_share=0.6))


_TYPES = {"user_id": "bigint", "day": "bigint"}


@query(
    "table_profile",
    f"""WITH {PANEL_SQL}, profile AS ({_PROFILE_SQL})
    SELECT "column", CASE WHEN "column" IN ('user_id', 'day') THEN 'bigint' ELSE 'double' END AS "type",
    n_rows, n_missing, round(100.0 * n_missing / n_rows, 2) + 0.0 AS missing_pct,
    CAST(CASE WHEN 100.0 * n_missing / n_rows > 5 THEN 1 ELSE 0 END AS INTEGER) AS notable FROM profile""",
)
def _(t: Tables):
    return quality.table_profile(panel(t))


_FILLED_NUMBERS = (*ANALYTES, "Total_IgE", "Age_years", "Gender", "Poverty_income_ratio", "Education_level", "BMI", "interview_month")


def _mode_sql(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM (SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) "
        f"ORDER BY n DESC, {column} LIMIT 1)"
    )


def imputed_sql(source: str, numbers, texts) -> str:
    cells = [f'coalesce(CAST("{c}" AS DOUBLE), (SELECT median("{c}") FROM {source})) AS "{c}"' for c in numbers]
    cells += [f'coalesce("{c}", {_mode_sql(c, source)}) AS "{c}"' for c in texts]
    return ", ".join(cells)


@query(
    "impute_median_mode",
    f"""WITH {SURVEY_SQL}, filled AS (SELECT "SEQN", {imputed_sql('survey', _FILLED_NUMBERS, ['segment'])} FROM survey)
    SELECT "SEQN", segment, {', '.join(r6(f'"{c}"', f'"{c}"') for c in _FILLED_NUMBERS)} FROM filled""",
)
def _(t: Tables):
    return missing.impute(survey(t))


@query(
    "column_medians",
    """SELECT 'l_quantity' AS "column", median(l_quantity) + 0.0 AS value FROM lineitem
    UNION ALL SELECT 'l_extendedprice', round(median(l_extendedprice), 6) FROM lineitem
    UNION ALL SELECT 'l_discount', round(median(l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_tax', round(median(l_tax), 6) FROM lineitem
    UNION ALL SELECT 'l_partkey', median(l_partkey) FROM lineitem""",
)
def _(t: Tables):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    medians = missing.column_medians(t.lineitem.select(*columns), columns)
    return t.spark.createDataFrame(list(medians.items()), "column string, value double")


def _narrow_sql(column: str, source: str) -> str:
    whole = (
        f"CASE WHEN lo >= 0 AND hi < 255 THEN 'smallint' WHEN lo >= 0 AND hi < 65535 THEN 'int' "
        f"WHEN lo >= 0 AND hi < 10000 THEN 'bigint' WHEN lo < 0 AND lo > -128 AND hi < 127 THEN 'tinyint' "
        f"WHEN lo < 0 AND lo > -32768 AND hi < 32767 THEN 'smallint' "
        f"WHEN lo < 0 AND abs(lo) < 10000 AND hi < 10000 THEN 'int' ELSE old END"
    )
    return (
        f"SELECT '{column}' AS \"column\", old AS old_type, {whole} AS new_type, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high, "
        f"CAST(NULL AS BIGINT) AS n_values, CAST(0 AS INTEGER) AS as_dictionary FROM "
        f"(SELECT {{0}} AS old, min({column}) AS lo, max({column}) AS hi FROM {source})"
    )


def _text_sql(column: str) -> str:
    return (
        f"SELECT '{column}', 'string', 'string', NULL, NULL, count(DISTINCT {column}), "
        f"CAST(CASE WHEN count(DISTINCT {column}) / count(*) < 0.5 THEN 1 ELSE 0 END AS INTEGER) FROM part"
    )


@query(
    "schema_narrowing",
    " UNION ALL ".join(
        [_narrow_sql("p_partkey", "part").format("'bigint'"), _narrow_sql("p_size", "part").format("'int'")]
        + [_text_sql(c) for c in ("p_name", "p_brand", "p_type")]
        + ["SELECT 'p_retailprice', 'double', 'float', NULL, NULL, NULL, 0 FROM (SELECT count(*) FROM part)"]
        + [_narrow_sql("shifted", "(SELECT p_size - 30 AS shifted FROM part)").format("'int'")]
    ),
)
def _(t: Tables):
    return missing.narrowing_plan(t.part.withColumn("shifted", F.col("p_size") - 30))


@query(
    "narrowed_table",
    """SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size, p_brand, round(p_retailprice, 1) AS p_retailprice FROM part""",
)
def _(t: Tables):
    narrowed = missing.narrow_types(t.part.select("p_partkey", "p_size", "p_brand", "p_retailprice"))
    return narrowed.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        "p_size",
        "p_brand",
        F.round(F.col("p_retailprice").cast("double"), 1).alias("p_retailprice"),
    )


# --------------------------------------------------------------------------------------------
# balance


@query(
    "class_balance",
    """SELECT quality, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM labels), 6) + 0.0 AS share,
    round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * CAST(count(*) AS DOUBLE)), 6) + 0.0 AS weight
    FROM labels GROUP BY 1""",
)
def _(t: Tables):
    return prepare.class_balance(t.labels, "quality")


@query(
    "class_weights",
    f"""WITH {LABELLED_SQL}, w AS (SELECT quality, (SELECT count(*) FROM labelled) / (2 * CAST(count(*) AS DOUBLE)) AS w FROM labelled GROUP BY 1)
    SELECT doc_id, labelled.quality, {r6('w', 'weight')} FROM labelled JOIN w USING (quality)""",
)
def _(t: Tables):
    return prepare.with_class_weight(labelled(t).select("doc_id", "quality"), "quality")


_KNN_SQL = """WITH pairs AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbor,
    list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS place FROM pairs)
  SELECT vec_id, neighbor, round(distance, 6) + 0.0 AS distance, CAST(place AS INTEGER) AS neighbor_rank
  FROM ranked WHERE place <= 5"""


@query("knn_neighbors", _KNN_SQL)
def _(t: Tables):
    return nearest_neighbors(t.embeddings, "vec_id", "embedding", 5)


_MINORITY = "(SELECT quality FROM labelled GROUP BY 1 ORDER BY count(*), quality LIMIT 1)"


@query(
    "interpolated_augmentation",
    f"""WITH {LABELLED_SQL},
    small AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM labelled WHERE quality = {_MINORITY}),
    size AS (SELECT count(*) AS m FROM small),
    near AS (SELECT a.doc_id, b.doc_id AS other, row_number() OVER (PARTITION BY a.doc_id
      ORDER BY pow(a.n_chars - b.n_chars, 2) + pow(a.n_spaces - b.n_spaces, 2), b.doc_id) AS place
      FROM small a JOIN small b ON a.doc_id <> b.doc_id),
    numbers AS (SELECT unnest(range(CAST(floor(m * 0.5) AS BIGINT))) AS i, m FROM size),
    draws AS (SELECT i, {pick_sql('i', 'm', 101)} AS base, {pick_sql('i', 'least(5, m - 1)', 103)} + 1 AS k,
      {uniform_sql('i', 107)} AS gap, {pick_sql('i', 'm', 1000)} AS at_source, {pick_sql('i', 'm', 1001)} AS at_lang FROM numbers),
    made AS (SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(b.quality AS DOUBLE) AS quality,
      b.n_chars + gap * (o.n_chars - b.n_chars) AS n_chars, b.n_spaces + gap * (o.n_spaces - b.n_spaces) AS n_spaces,
      s.source AS source, l.lang AS lang
      FROM draws JOIN small b ON b.place = base JOIN near ON near.doc_id = b.doc_id AND near.place = k
      JOIN small o ON o.doc_id = near.other JOIN small s ON s.place = at_source JOIN small l ON l.place = at_lang)
    SELECT doc_id, quality, {r6('n_chars', 'n_chars')}, {r6('n_spaces', 'n_spaces')}, source, lang FROM made
    UNION ALL SELECT doc_id, CAST(quality AS DOUBLE), n_chars, n_spaces, source, lang FROM labelled""",
)
def _(t: Tables):
    rows = labelled(t).withColumn("quality", F.col("quality").cast("double"))
    return balance_classes(rows, "quality", "doc_id")


# --------------------------------------------------------------------------------------------
# preparation


def _ordered(source: str, group: str | None, key: str, salt: int) -> str:
    part = f"PARTITION BY {group} " if group else ""
    over = f"PARTITION BY {group}" if group else ""
    return (
        f"placed AS (SELECT *, row_number() OVER ({part}ORDER BY {mix_sql(key, salt)}, {key}) AS place, "
        f"count(*) OVER ({over}) AS group_rows FROM {source})"
    )


@query(
    "stratified_split",
    f"""WITH {_ordered('labels', 'quality', 'doc_id', 42)}
    SELECT doc_id, quality, CAST(CASE WHEN place <= floor(group_rows * 0.2 + 0.5) THEN 1 ELSE 0 END AS INTEGER) AS is_test FROM placed""",
)
def _(t: Tables):
    return prepare.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query(
    "plain_split",
    f"""WITH {_ordered('orders', None, 'o_orderkey', 7)}
    SELECT o_orderkey, CAST(CASE WHEN place <= floor(group_rows * 0.25 + 0.5) THEN 1 ELSE 0 END AS INTEGER) AS is_test FROM placed""",
)
def _(t: Tables):
    return prepare.stratified_split(t.orders.select("o_orderkey"), "o_orderkey", test_size=0.25, salt=7)


@query(
    "stratified_folds",
    f"""WITH {_ordered('orders', 'o_orderstatus', 'o_orderkey', 42)}
    SELECT o_orderkey, o_orderstatus, CAST(floor((place - 1) * 5 / group_rows) AS INTEGER) AS fold FROM placed""",
)
def _(t: Tables):
    return prepare.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query(
    "group_positions",
    f"""WITH {_ordered('events', 'user_id', 'event_id', 3)} SELECT event_id, user_id, place AS position FROM placed""",
)
def _(t: Tables):
    from panelwise.functions.hashing import mix
    from panelwise.operators.ranking import position_in_group

    rows = t.events.select("event_id", "user_id", mix(F.col("event_id"), 3).alias("mixed"))
    return position_in_group(rows, "user_id", "mixed", "event_id", "position").drop("mixed")


@query(
    "standardize",
    f"""WITH {LABELLED_SQL}, {_ordered('labelled', 'quality', 'doc_id', 42)},
    split AS (SELECT *, place <= floor(group_rows * 0.2 + 0.5) AS is_test FROM placed),
    fit AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(n_spaces) AS m2, stddev_pop(n_spaces) AS s2 FROM split WHERE NOT is_test)
    SELECT doc_id, {r6('(n_chars - m1) / s1', 'n_chars')}, {r6('(n_spaces - m2) / s2', 'n_spaces')}, CAST(0 AS DOUBLE) AS constant FROM split, fit""",
)
def _(t: Tables):
    rows = labelled(t).select("doc_id", "quality", "n_chars", "n_spaces", F.lit(5.0).alias("constant"))
    split = prepare.stratified_split(rows, "doc_id", "quality")
    scaler = prepare.fit_scaler(split.where("is_test = 0"), ["n_chars", "n_spaces", "constant"])
    return scaler.apply(split).drop("quality", "is_test")


@query(
    "label_encode",
    """SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label FROM customer""",
)
def _(t: Tables):
    coded, _classes = prepare.with_label(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return coded


@query("target_filter", f"WITH {SURVEY_SQL} SELECT \"SEQN\", \"Age_years\" FROM survey WHERE \"Age_years\" IS NOT NULL")
def _(t: Tables):
    return survey(t).where(F.col("Age_years").isNotNull()).select("SEQN", "Age_years")


# --------------------------------------------------------------------------------------------
# sources, stages


def _normal_sql(key: str, mean: float, std: float, salt: int) -> str:
    return f"({mean} + {std} * sqrt(-2.0 * ln(1 - {uniform_sql(key, salt)})) * cos(2 * pi() * {uniform_sql(key, salt + 1)}))"


def _exponential_sql(key: str, scale: float, salt: int) -> str:
    return f"(-ln(1 - {uniform_sql(key, salt)}) * {scale})"


def _choice_sql(key: str, values: list, salt: int) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[CAST(floor({uniform_sql(key, salt)} * {len(values)}) AS INTEGER) + 1]"


def _clip_sql(value: str, low: float, high: float) -> str:
    return f"least(greatest({value}, {low}), {high})"


def _panel_sql(code: str, salt: int) -> str:
    k = "c_custkey"
    draw = _exponential_sql(k, 1.0, salt + 1)
    value = (
        f"CASE WHEN {uniform_sql(k, salt)} < 0.3 / (1.0 + exp(3.5 - lt)) THEN {draw} * 2.0 + 0.35 "
        f"ELSE {draw} * 0.1 END"
    )
    return r6(_clip_sql(value, 0.01, 100.0), f'"{code}"')


_K = "c_custkey"


@query(
    "synthetic_survey",
    f"""WITH base AS (SELECT c_custkey, {_normal_sql(_K, 3.5, 1.2, 7)} AS lt FROM customer)
    SELECT c_custkey AS "SEQN", CAST({_choice_sql(_K, [1, 2], 1)} AS INTEGER) AS "RIAGENDR",
    {r6(_clip_sql(_normal_sql(_K, 45.0, 20.0, 2), 2.0, 85.0), '"RIDAGEYR"')},
    CAST({_choice_sql(_K, [1, 2, 3, 4, 5], 4)} AS INTEGER) AS "RIDRETH1",
    CAST({_choice_sql(_K, [1, 2, 3, 4, 5], 5)} AS INTEGER) AS "DMDEDUC2",
    {r6(_clip_sql(_exponential_sql(_K, 2.0, 6), 0.0, 5.0), '"INDFMPIR"')},
    {r6(_clip_sql('exp(lt)', 2.0, 5000.0), '"LBXIGE"')},
    {', '.join(_panel_sql(code, 100 + 2 * i) for i, code in enumerate(ANALYTE_CODES))} FROM base""",
)
def _(t: Tables):
    return survey_from_ids(t.customer, "c_custkey")


@query(
    "synthetic_trial",
    f"""SELECT 'SUB' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS subject_id,
    {_choice_sql(_K, ['observational_food', 'peanut_sublingual', 'peanut_epicutaneous'], 201)} AS study,
    {r6(_clip_sql(_normal_sql(_K, 30.0, 15.0, 202), 5.0, 75.0), 'age')},
    {_choice_sql(_K, ['Male', 'Female'], 204)} AS gender, {r6(f'exp({_normal_sql(_K, 4.0, 1.0, 205)})', 'baseline_ige')},
    {r6(_exponential_sql(_K, 2.0, 207), 'peanut_ige')}, {r6(_exponential_sql(_K, 1.5, 208), 'milk_ige')},
    {r6(_exponential_sql(_K, 1.8, 209), 'egg_ige')},
    {_choice_sql(_K, ['responder', 'non_responder', 'partial'], 210)} AS treatment_response FROM customer""",
)
def _(t: Tables):
    return trial_from_ids(t.customer, "c_custkey")


_SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_ORDER_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM orders"""


def _orders_with_gaps(t: Tables):
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )


@query("dump_roundtrip", _ORDER_SQL)
def _(t: Tables):
    rows = _orders_with_gaps(t)
    path = new_table_path(t.spark, "dump")
    write_dump(rows, path)
    return read_dump(t.spark, path, rows.schema)


@query("delimited_roundtrip", _ORDER_SQL)
def _(t: Tables):
    rows = _orders_with_gaps(t)
    path = new_table_path(t.spark, "tab")
    upper = rows.toDF(*[c.upper() for c in rows.columns])
    upper.write.option("header", True).option("sep", "\t").csv(path)
    return read_delimited(t.spark, path, rows.schema)


@query("stage_reload", f"{_SUPPLIER_SQL} UNION ALL {_SUPPLIER_SQL}")
def _(t: Tables):
    path = new_table_path(t.spark, "stage")
    save_table(t.supplier, path)
    saved = load_table(t.spark, path)
    missing_stage = load_optional(t.spark, f"{path}-absent", saved.schema)
    return saved.unionByName(missing_stage).unionByName(load_optional(t.spark, path, saved.schema))


@query(
    "reused_result",
    "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 6) + 0.0 AS total FROM orders GROUP BY 1",
)
def _(t: Tables):
    folder = new_table_path(t.spark, "reuse")
    totals = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    first = reuse(totals, [t.orders], "order-totals", folder)
    return reuse(first.where("n_orders < 0"), [t.orders], "order-totals", folder)  # the stored copy, not this plan


@query(
    "transport_roundtrip",
    f"""SELECT CAST(o_orderkey AS DOUBLE) AS okey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, {r6('-CAST(o_custkey AS DOUBLE) / 3', 'share')},
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS prio FROM orders""",
)
def _(t: Tables):
    """Written as transport files of a task each, read by ranges of some hundred rows."""
    rows = t.orders.select(
        F.col("o_orderkey").cast("double").alias("okey"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        (-F.col("o_custkey").cast("double") / 3).alias("share"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("prio"),
    )
    folder = new_table_path(t.spark, "transport")
    write_xport(rows, folder)
    return read_xport(t.spark, [p for p, _, _ in list_folder(t.spark, folder) if p.endswith(".xpt")], range_bytes=1 << 17)


_TORN_SQL = """torn AS (SELECT *, CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
  o_orderkey % 97 = 0 AS extra, o_orderkey % 83 = 0 AS short FROM orders)"""


@query(
    "delimited_rejects",
    f"""WITH {_TORN_SQL}, kept AS (SELECT * FROM torn WHERE NOT extra)
    SELECT 'row' AS kind, o_orderkey, CAST(try_cast(cust AS BIGINT) AS BIGINT) AS o_custkey, CASE WHEN NOT short THEN o_orderstatus END AS o_orderstatus, NULL AS reason, NULL AS row_kept FROM kept
    UNION ALL SELECT 'reject', o_orderkey, NULL, NULL, 'too many fields: 4 of 3', FALSE FROM torn WHERE extra
    UNION ALL SELECT 'reject', o_orderkey, NULL, NULL, 'o_custkey: ''n/a'' is no bigint', TRUE FROM kept WHERE cust = 'n/a'""",
)
def _(t: Tables):
    """Lines with a field too many, too few, or a number that is none."""
    key = F.col("o_orderkey")
    fields = [
        key.cast("string"),
        F.when(key % 89 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")),
        F.when(key % 83 != 0, F.col("o_orderstatus")),
        F.when(key % 97 == 0, F.when(key % 83 != 0, F.lit("more")).otherwise(F.lit("\tmore"))),
    ]
    path = new_table_path(t.spark, "torn")
    head = t.spark.range(0, 1, 1, 1).select(F.lit("o_orderkey\to_custkey\to_orderstatus").alias("value"))
    # Each file begins with the header.
    lines = t.orders.select(F.concat_ws("\t", *fields).alias("value"), F.spark_partition_id().alias("part"))
    headed = lines.select("value", "part", F.lit(1).alias("place")).unionByName(
        lines.select("part").distinct().join(head).select("value", "part", F.lit(0).alias("place"))
    )
    headed.repartition("part").sortWithinPartitions("part", "place").select("value", "part").write.partitionBy("part").text(path)
    schema = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").schema
    files = [p for folder, _, _ in list_folder(t.spark, path) if "part=" in folder for p, _, _ in list_folder(t.spark, folder) if p.endswith(".txt")]
    rows, rejects = read_with_rejects(t.spark, files, schema)
    none = lambda kind: F.lit(None).cast(kind)
    first = F.split("line", "\t")[0].cast("bigint")
    wrong = rejects.select(F.lit("reject").alias("kind"), first.alias("o_orderkey"), none("bigint").alias("o_custkey"), none("string").alias("o_orderstatus"), "reason", "row_kept")
    return rows.select(F.lit("row").alias("kind"), "o_orderkey", "o_custkey", "o_orderstatus", none("string").alias("reason"), none("boolean").alias("row_kept")).unionByName(wrong)


def _move_parts(t: Tables, folder: str, place) -> None:
    parts = sorted(p for p, _, _ in list_folder(t.spark, folder) if p.rsplit("/", 1)[-1].startswith("part-"))
    for i, path in enumerate(parts):
        move(t.spark, path, place(i))


@query(
    "study_tables",
    """SELECT 'SUB' || c_custkey AS subject_accession, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS gender, CAST(c_nationkey AS INTEGER) AS workspace_id,
    CASE c_custkey % 3 WHEN 0 THEN 'SDY1513' ELSE 'SDY1520' END AS study FROM customer WHERE c_custkey % 3 < 2""",
)
def _(t: Tables):
    """One study as tab exports, with a dump that must not be read; one as a dump only."""
    root = new_table_path(t.spark, "studies")
    names = [f.name for f in TRIAL_TABLES["subject"].schema.fields]
    given = {
        "subject_accession": F.concat(F.lit("SUB"), F.col("c_custkey").cast("string")),
        "gender": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")),
        "workspace_id": F.col("c_nationkey").cast("string"),
    }
    rows = t.customer.select((F.col("c_custkey") % 3).alias("part"), *[given.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    part = lambda n: rows.where(F.col("part") == n).select(*names)
    part(0).toDF(*[n.upper() for n in names]).write.option("header", True).option("sep", "\t").csv(f"{root}-tab")
    _move_parts(t, f"{root}-tab", lambda i: f"{root}/A {i}/SDY1513-X_Tab/Tab/subject.txt")
    for n, study in ((1, "SDY1520"), (2, "SDY1513")):
        write_dump(part(n), f"{root}-dump-{n}")
        _move_parts(t, f"{root}-dump-{n}", lambda i, study=study: f"{root}/B {i}/{study}-X_MySQL/MySQL/subject.txt")
    return read_study_table(t.spark, root, "subject").select("subject_accession", "gender", "workspace_id", "study")


@query(
    "lab_files",
    f"""WITH lab AS (SELECT DISTINCT 'SUB' || o_custkey AS subject_accession, o_orderstatus, month(o_orderdate) AS visit, o_totalprice FROM orders WHERE o_orderstatus <> 'P')
    SELECT subject_accession, {r6("avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)", '"F_IGE"')},
    {r6("avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)", '"O_IGE"')} FROM lab GROUP BY 1""",
)
def _(t: Tables):
    """Laboratory files that lie in two places, averaged by subject and antigen."""
    root = new_table_path(t.spark, "studies")
    names = [f.name for f in LAB_RESULTS.schema.fields]
    given = {
        "Accession": F.concat(F.lit("SUB"), F.col("o_custkey").cast("string")),
        "VISNO": F.month("o_orderdate").cast("string"),
        "IGEANTIG": F.col("o_orderstatus"),
        "IGEANTIB": F.lit("IGE"),
        "IGERESL": F.col("o_totalprice").cast("string"),
    }
    rows = t.orders.where("o_orderstatus <> 'P'").select(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    for copy in ("StudyFiles", "StudyFiles/Again"):
        rows.write.option("header", True).option("sep", "\t").csv(f"{root}-{copy[-5:]}")
        _move_parts(t, f"{root}-{copy[-5:]}", lambda i, copy=copy: f"{root}/{copy}/lab{i}_IgE.txt")
    return lab_panel(read_lab_results(t.spark, root), ["F_IGE", "O_IGE"]).select("subject_accession", "F_IGE", "O_IGE")


@query(
    "report_fold",
    """WITH nations AS (SELECT n_nationkey, n_name FROM nation), regions AS (SELECT r_regionkey, r_name FROM region)
    SELECT 'nations' AS name, n_name AS value, 2 AS tables, (SELECT count(*) FROM nations) AS entries FROM nations
    UNION ALL SELECT 'regions', r_name, 2, (SELECT count(*) FROM regions) FROM regions""",
)
def _(t: Tables):
    """The final report, saved and read again, taken apart into its entries."""
    path = new_table_path(t.spark, "report")
    results = {"nations": t.nation.select("n_nationkey", "n_name"), "regions": t.region.select("r_regionkey", "r_name")}
    report = final_report(t.spark, {"test_size": 0.2}, results, {"status": "completed"})
    save_table(report, path)
    kept = load_table(t.spark, path).select(F.size("results").alias("tables"), F.explode("results").alias("name", "rows"))
    entries = kept.select("name", "tables", F.size("rows").cast("bigint").alias("entries"), F.explode("rows").alias("row"))
    value = F.coalesce(F.get_json_object("row", "$.n_name"), F.get_json_object("row", "$.r_name"))
    return entries.select("name", value.alias("value"), "tables", "entries")


# --------------------------------------------------------------------------------------------
# quality

_RULES = {
    "customer": TrialTable("customer", None, ("c_custkey",), ("c_custkey", "c_mktsegment")),
    "orders": TrialTable("orders", None, ("o_orderkey",), ("o_orderstatus",), {"o_custkey": "customer"}),
    "lineitem": TrialTable("lineitem", None, ("l_orderkey", "l_linenumber"), (), {"l_orderkey": "orders"}),
    "events": TrialTable("events", None, ("user_id",), ("value",), {"user_id": "customer"}),
}


@query(
    "constraint_checks",
    """WITH keys AS (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS v FROM lineitem)
    SELECT 'customer' AS "table", 'primary_key' AS rule, 'c_custkey' AS "column", count(*) - count(DISTINCT c_custkey) AS violations FROM customer
    UNION ALL SELECT 'customer', 'not_null', 'c_custkey', count(*) - count(c_custkey) FROM customer
    UNION ALL SELECT 'customer', 'not_null', 'c_mktsegment', count(*) - count(c_mktsegment) FROM customer
    UNION ALL SELECT 'orders', 'primary_key', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'orders', 'not_null', 'o_orderstatus', count(*) FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT 'orders', 'foreign_key', 'o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lineitem', 'primary_key', 'l_orderkey,l_linenumber', v FROM keys
    UNION ALL SELECT 'lineitem', 'foreign_key', 'l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'events', 'primary_key', 'user_id', count(*) - count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'events', 'not_null', 'value', count(*) - count(value) FROM events
    UNION ALL SELECT 'events', 'foreign_key', 'user_id', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t: Tables):
    tables = {"customer": t.customer, "orders": _orders_with_gaps(t), "lineitem": t.lineitem, "events": t.events}
    return quality.constraint_checks(tables, _RULES)


@query(
    "table_fingerprint",
    """SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns, CAST(1 AS INTEGER) AS order_free,
    CAST(1 AS INTEGER) AS notices_change FROM lineitem""",
)
def _(t: Tables):
    """The same for any order of the rows and columns, another one after a single changed cell."""
    plain = quality.table_fingerprint(t.lineitem)
    shuffled = t.lineitem.repartition(7, "l_partkey").sortWithinPartitions(F.desc("l_tax"))
    first = t.lineitem.agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("k")).first()["k"]
    at_first = (F.col("l_orderkey") == first[0]) & (F.col("l_linenumber") == first[1]) & (F.col("l_partkey") == first[2])
    changed = t.lineitem.withColumn("l_tax", F.when(at_first, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    marks = [quality.table_fingerprint(df).first()["fingerprint"] for df in (shuffled, changed)]
    return plain.select(
        "n_rows",
        "n_columns",
        (F.col("fingerprint") == marks[0]).cast("int").alias("order_free"),
        (F.col("fingerprint") != marks[1]).cast("int").alias("notices_change"),
    )


@query(
    "chunk_sums",
    """WITH numbered AS (SELECT event_id, value, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS chunk FROM events)
    SELECT chunk, count(*) AS n_rows, min(event_id) AS first_id, round(sum(value * 2 + 1), 6) + 0.0 AS applied FROM numbered GROUP BY 1""",
)
def _(t: Tables):
    chunked = quality.with_chunks(t.events.select("event_id", "value"), "event_id", 1000)

    def double_plus_one(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(applied=rows["value"] * 2 + 1)

    applied = quality.map_chunks(chunked, double_plus_one, "event_id bigint, value double, chunk bigint, applied double")
    return applied.groupBy("chunk").agg(
        F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.sum("applied").alias("applied")
    )


@query(
    "column_apply",
    """SELECT 'l_quantity' AS "column", round(max(l_quantity) - min(l_quantity), 6) + 0.0 AS value FROM lineitem
    UNION ALL SELECT 'l_tax', round(max(l_tax) - min(l_tax), 6) + 0.0 FROM lineitem
    UNION ALL SELECT 'l_discount', round(max(l_discount) - min(l_discount), 6) + 0.0 FROM lineitem""",
)
def _(t: Tables):
    return quality.map_columns(t.lineitem, lambda c: F.max(c) - F.min(c), ["l_quantity", "l_tax", "l_discount"])


@query(
    "requirements_check",
    """SELECT 'complete' AS "check", CAST(1 AS INTEGER) AS ok FROM (SELECT count(*) AS n FROM orders) WHERE n >= 100
    UNION ALL SELECT 'missing column', 0 FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'too few rows', CAST(CASE WHEN n >= 6 THEN 1 ELSE 0 END AS INTEGER) FROM (SELECT count(*) AS n FROM region)""",
)
def _(t: Tables):
    results = [
        ("complete", int(quality.meets_requirements(t.orders, ["o_orderkey", "o_custkey"], 100))),
        ("missing column", int(quality.meets_requirements(t.orders, ["o_orderkey", "absent"]))),
        ("too few rows", int(quality.meets_requirements(t.region, ["r_name"], 6))),
    ]
    return t.spark.createDataFrame(results, "check string, ok int")
