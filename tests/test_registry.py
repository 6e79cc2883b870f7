"""Every query of the catalog against its SQL on whole tables, and the shape of its plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from conftest import TESTDATA  # noqa: E402
from cross_check import connect, difference  # noqa: E402
from retail_spark import catalog  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()
FORBIDDEN = ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) == 153
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("key", QUERIES)
def test_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, TESTDATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    result = duck.execute(ORACLE[key])
    names = [d[0] for d in result.description]
    assert difference((df.columns, [tuple(r) for r in df.collect()]), (names, result.fetchall())) == ""


def test_entry_point(spark):
    assert entry_points.entry(spark).count() == 10
