"""The driver contract: entry() smoke, and every registered query against
its DuckDB oracle on the smallest tables."""

import pytest

from paths import SF001
from oracle_harness import compare, duck

import __spark_entry__ as E
from haze.plans.oracle_queries import ORACLE
from haze.plans.queries import QUERIES


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["quality", "n", "avg_aqi", "min_aqi", "max_aqi", "share"]


def test_every_query_has_an_oracle_or_is_random():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF001)
    assert res["status"] in ("ok", "rows-only"), res
