"""Every query with oracle SQL gives the same rows in Spark and DuckDB (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check_oracle import canon

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_key_is_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck_small, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck_small.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert canon(got) == canon(want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "event_id" in df.columns
