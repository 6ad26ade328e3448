"""Scale rules checked on the physical plans of every registered query."""

import __spark_entry__ as entry
from veracity.plans import domain as D

SMOKE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    bad = {}
    for name, fn in entry.queries().items():
        plan = _plan(fn(spark, SMOKE))
        found = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if found:
            bad[name] = found
    assert bad == {}


def test_heavy_scans_are_pruned(spark):
    facts = D.order_facts(spark, SMOKE, materialize=False)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    # The line-item scan of the audit reads one column, with the null filter pushed into Parquet.
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan
