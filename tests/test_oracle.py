"""Every registered query that has SQL, against that SQL on DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

PATH = os.environ.get("BARSIGHT_ORACLE_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def db():
    return connect(PATH)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, PATH).toPandas()
    assert len(got)
    assert difference(got, db.execute(SQL[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["session", "target_position", "mult", "train_sharpe"]
    assert df.count() == 10
