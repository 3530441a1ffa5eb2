"""Every query with an oracle, compared on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, oracle

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) == ""
