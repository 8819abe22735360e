"""Every registered query against its SQL oracle, value by value."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, duckdb_rows, spark_rows

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# Queries of the llm subpackage have tests of their own.
QUERIES = {name: q for name, q in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.LLM_QUERIES}

# Parameter choices that leave nothing to report would prove nothing.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, connection, name):
    spark_names, ours = spark_rows(QUERIES[name](spark, SF_DIR))
    duck_names, theirs = duckdb_rows(connection, ORACLES[name])
    assert spark_names == duck_names
    missing, extra = theirs - ours, ours - theirs
    assert not missing and not extra, (
        f"{sum(missing.values())} rows missing, e.g. {list(missing)[:3]}; "
        f"{sum(extra.values())} unexpected, e.g. {list(extra)[:3]}"
    )
    assert ours or name in MAY_BE_EMPTY


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
