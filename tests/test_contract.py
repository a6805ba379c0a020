from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidegauge.plans.catalog import QUERIES
from tidegauge.plans.oracle import ORACLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import canonical  # noqa: E402


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, folder, name):
    ours = entry.queries()[name](spark, folder).toPandas()
    cursor = db.execute(entry.oracle_sql()[name])
    theirs = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
