"""Every query with SQL gives DuckDB's rows at the scale of the driver's gate."""

from __future__ import annotations

import pytest

from assayframe.plans import all_queries
from tests.compare import differences, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(all_queries.QUERIES[name](spark, SF), all_queries.ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLES)))
def test_runs_without_sql(spark, name):
    assert all_queries.QUERIES[name](spark, SF).count() > 0
