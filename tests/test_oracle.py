"""Every registered query against its DuckDB SQL at sf0.001; the driver repeats this at sf0.01."""

import pytest

from fareflow.catalog import all_oracles, all_queries
from tests.compare import compare, duck

QUERIES, ORACLES = all_queries(), all_oracles()
#: Right results without rows on the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, sf, name):
    problem, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert problem is None or (problem == "empty" and name in EMPTY), problem


@pytest.mark.parametrize("name", ["ml_coefficients"])
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
