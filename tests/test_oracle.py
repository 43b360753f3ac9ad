"""Every registered query against its DuckDB statement."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


# The text operators have tests of their own.
OURS = sorted(set(contract.queries()) - set(contract.TEXT_QUERIES))


def test_every_query_has_an_oracle():
    assert set(OURS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", OURS)
def test_matches_oracle(spark, duck, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(contract.oracle_sql()[name]).df()
    assert differences(ours, theirs) == []


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0
    assert "trend_signal" in out.columns


@pytest.mark.parametrize("name", OURS)
def test_oracle_has_rows(name):
    duck = connect("/root/testdata/sf0.01")
    assert duck.execute(f"SELECT count(*) FROM ({contract.oracle_sql()[name]})").fetchall()[0][0] > 0
