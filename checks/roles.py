"""The roles the test tables play, as DataFrames and as SQL with the same meaning.

* panel       one row per user and day of ``events``, a column per event type and their total
* subject     ``customer`` with an age, a gender, an income ratio and an education level
* survey      panel joined to its subject
* labelled    ``labels`` joined to ``documents``: two numbers and a class
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.hashing import salt_constants
from panelwise.operators.panel import pivot_panel
from panelwise.options import Thresholds
from panelwise.session import configure

ANALYTES = ("click", "error", "purchase", "signup", "view")
GROUPS = {"indoor": ("click", "view"), "outdoor": ("signup",), "food": ("error", "purchase")}
LIMITS = Thresholds(sensitized_at=50.0)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its result columns of type DOUBLE are rounded to six digits."""

    def register(make):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(make(Tables(configure(spark), folder)))

        QUERIES[name] = Query(name, run, None if sql is None else " ".join(sql.split()))
        return make

    return register


class Tables:
    """The parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# --------------------------------------------------------------------------------------------
# panel

PANEL_SQL = (
    "panel AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, "
    + ", ".join(
        f"round(avg(CASE WHEN event_type = '{a}' THEN value END), 4) AS {a}" for a in ANALYTES
    )
    + ", round(sum(value), 4) AS total FROM events GROUP BY 1, 2)"
)


def panel(t: Tables) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day")
    wide = pivot_panel(t.events.select("user_id", day, "event_type", "value"), ["user_id", "day"], "event_type", "value", ANALYTES, "total")
    return wide.select("user_id", "day", *[F.round(c, 4).alias(c) for c in (*ANALYTES, "total")])


# --------------------------------------------------------------------------------------------
# subjects

SUBJECT_SQL = """subject AS (SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 103 AS DOUBLE) END AS age,
  CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS gender,
  CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal / 2000.0 END AS income,
  CASE WHEN c_custkey % 29 <> 0 THEN CAST(c_nationkey % 6 AS INTEGER) END AS education,
  CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment,
  CAST(16 + c_custkey % 20 AS DOUBLE) AS bmi,
  CAST(1 + c_custkey % 12 AS INTEGER) AS interview_month
  FROM customer)"""


def subject(t: Tables) -> DataFrame:
    key = F.col("c_custkey")

    def unless(step: int, value):
        return F.when(key % step != 0, value)

    return t.customer.select(
        key.alias("user_id"),
        unless(17, (key % 103).cast("double")).alias("age"),
        unless(19, (key % 3).cast("int")).alias("gender"),
        unless(23, F.col("c_acctbal") / 2000.0).alias("income"),
        unless(29, (F.col("c_nationkey") % 6).cast("int")).alias("education"),
        unless(11, F.col("c_mktsegment")).alias("segment"),
        (16 + key % 20).cast("double").alias("bmi"),
        (1 + key % 12).cast("int").alias("interview_month"),
    )


# --------------------------------------------------------------------------------------------
# survey

SURVEY_SQL = f"""{PANEL_SQL}, {SUBJECT_SQL},
  survey AS (SELECT panel.user_id * 1000 + day AS SEQN, {', '.join(ANALYTES)}, total AS "Total_IgE",
    age AS "Age_years", gender AS "Gender", income AS "Poverty_income_ratio",
    education AS "Education_level", segment, bmi AS "BMI", interview_month
    FROM panel LEFT JOIN subject ON panel.user_id = subject.user_id)"""


def survey(t: Tables) -> DataFrame:
    joined = panel(t).join(subject(t), "user_id", "left")
    return joined.select(
        (F.col("user_id") * 1000 + F.col("day")).alias("SEQN"),
        *ANALYTES,
        F.col("total").alias("Total_IgE"),
        F.col("age").alias("Age_years"),
        F.col("gender").alias("Gender"),
        F.col("income").alias("Poverty_income_ratio"),
        F.col("education").alias("Education_level"),
        "segment",
        F.col("bmi").alias("BMI"),
        "interview_month",
    )


# --------------------------------------------------------------------------------------------
# labelled documents

LABELLED_SQL = """labelled AS (SELECT labels.doc_id, quality, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces, source, lang
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""


def labelled(t: Tables) -> DataFrame:
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    docs = t.documents.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        spaces.cast("double").alias("n_spaces"),
        "source",
        "lang",
    )
    return t.labels.select("doc_id", "quality").join(docs, "doc_id")


# --------------------------------------------------------------------------------------------
# the id hash in SQL


def mix_sql(key: str, salt: int = 0) -> str:
    factor, offset = salt_constants(salt)
    key = f"CAST({key} AS BIGINT)"
    x = f"(({key} & 2147483647) * {factor} + ({key} >> 31) * 40503 + {offset}) % 4294967296"
    return f"((xor({x}, ({x}) >> 15) * 2053222611) % 4294967296)"


def uniform_sql(key: str, salt: int = 0) -> str:
    return f"(CAST({mix_sql(key, salt)} AS DOUBLE) / 4294967296.0)"


def pick_sql(key: str, n: str, salt: int = 0) -> str:
    return f"((({mix_sql(key, salt)}) >> 1) * 2147483648 + (({mix_sql(key, salt + 7919)}) >> 1)) % ({n})"


def flag_sql(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS INTEGER)"
