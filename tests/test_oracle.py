"""Every query that SQL can express gives DuckDB's rows, over the smallest tables."""

from functools import lru_cache

import pytest
from oracle import connection, differences

from ledgerloom.plans import more_queries, queries, scenario_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.fixture(scope="module", autouse=True)
def one_revenue_run():
    """The revenue scenario is matched once for all queries that read a part of it."""
    run, patch = lru_cache(queries.revenue_frames), pytest.MonkeyPatch()
    patch.setattr(queries, "revenue_frames", run)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, con, SMALL) == ([], [])
