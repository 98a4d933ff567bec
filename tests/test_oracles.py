"""Every ledger query equals its DuckDB oracle (sf0.001; the driver checks sf0.01).

The text operators' queries, some of which have no SQL form, are tested in tests/llm.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from outletlens.plans.registry import QUERIES

from .conftest import SF0001
from .oracle_compare import compare

NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "outlet_count" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, SF0001, name, queries()[name], oracle_sql()[name])
    assert ok, msg


# No cross or nested-loop join, and no Python evaluation: every registered
# query stays in JVM operators (whole-stage codegen).
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_in_plan(spark, name):
    plan = queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan], plan
