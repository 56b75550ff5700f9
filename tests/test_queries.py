"""Every registered query beside its SQL on the smallest test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# Trained on every run and compared by rows only: checked in test_models.
SLOW = {"train_default", "train_classifiers", "train_multiclass", "train_regressors", "explained_forest", "model_importance", "balanced_feature_table"}

SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW - set(entry.TEXT_QUERIES)))
def test_query(spark, database, name):
    df, sql = entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name]
    types = {row[0]: row[1] for row in database.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: SQL_TYPES[t] for c, t in df.dtypes} == types
    assert difference(df.toPandas(), database.execute(sql).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
