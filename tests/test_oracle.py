"""Every registered query with a SQL twin gives the same rows in both engines."""

from __future__ import annotations

import pytest

from callweave.plans import ORACLES, QUERIES
from tests.compare import compare, connect

# Walks ten folds or many model sizes; covered by test_evaluation on planted data.
SLOW = {"k_sweep", "cross_validate", "grid_search", "optimal_k"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
