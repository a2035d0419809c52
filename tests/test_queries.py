"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return verify.database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert verify.compare(name, [tuple(r) for r in df.collect()], df.columns, con, SQL[name]) == "ok"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not re.match(r"p\d+_", n)))
def test_runs(spark, con, name):
    QUERIES[name](spark, SF).count()


def test_names_match():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, con):
    assert entry.entry(spark).columns
