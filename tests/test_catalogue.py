"""Registered queries against their DuckDB twins on the smallest tables, and the driver's entry."""

import pytest

import __spark_entry__ as entry
from arbora.plans.catalogue import ORACLE, QUERIES
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    assert compare(spark, connect(DATA), QUERIES[name], ORACLE[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
