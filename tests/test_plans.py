"""Plan inspection: no cross products, and the flagship family keeps one exchange."""

import pytest

from newslens.plans import all_oracles, all_queries

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_no_cross_products(spark, name):
    plan = _plan(all_queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_topics_single_exchange_and_pruned_scan(spark):
    df = all_queries()["t2_topics"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
