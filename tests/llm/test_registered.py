"""The registered queries against their SQL, or for rows."""

from __future__ import annotations

import pytest

from oracle import compare, connect
from tidewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_registered(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], SF, ORACLES.get(name)) == ""
