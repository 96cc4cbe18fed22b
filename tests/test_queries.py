import importlib.util

import pytest
from helpers import same

from planforge.operators.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, duck, data, name):
    same(duck, QUERIES[name](spark, data), ORACLE_SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
    assert not e.HAS_LLM or importlib.util.find_spec("planforge.llm.queries") is not None


def test_bounds_hold(spark, data):
    got = dict(map(tuple, QUERIES["bound_report"](spark, data).collect()))
    assert got["exact"] <= got["rank bound"] <= got["frequency bound"]
