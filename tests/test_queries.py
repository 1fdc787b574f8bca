"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import SF, compare, connect
from tidewatch.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, QUERIES[name], SF, QUERIES[name].oracle)
    # a small table may leave a filtered query without rows, on both sides
    assert problem in ("", "both sides are empty")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
