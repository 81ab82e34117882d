"""Every registered query against its SQL: columns, types and all values."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from entries import ORACLES, QUERIES
from tests.oracle import compare, connect

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, queries()[name], ORACLE[name]) == []


def test_every_query_has_sql_but_the_random_one():
    assert set(QUERIES) - set(ORACLES) == {"sample_df"}
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(ORACLE)


def test_no_query_result_is_empty(con):
    empty = [n for n, sql in ORACLE.items() if not con.execute(f"SELECT * FROM ({sql}) LIMIT 1").fetchall()]
    assert empty == []


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "encounter_id" in df.columns
