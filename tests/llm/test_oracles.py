"""Registered queries against their DuckDB twins on the smallest tables."""

import pytest

from arbora.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    assert compare(spark, connect(DATA), QUERIES[name], ORACLE[name], DATA) is None


def test_sharding_query(spark):
    rows = QUERIES["op3_shard"](spark, DATA).collect()
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
