"""Every registered query against its DuckDB oracle (sf0.001), and the entry smoke check."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_check import compare, duck
from replaygate.plans.queries import ORACLE, QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    ok, msg = compare(df, con, E.oracle_sql()[name])
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert df.columns == E.entry(spark).columns
