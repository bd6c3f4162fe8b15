"""Plans: no all-pairs joins, filters and columns reach the scan, one shuffle where one is enough."""

import pytest

from shoplake import registry

SF = "/root/testdata/sf0.001"
SLOW = ("stream", "warehouse", "backfill", "mirror", "tsv", "upsert", "append", "write", "load", "read", "query_in",
        "materialised", "colocated")


def plan(spark, name):
    df = registry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.queries() if not n.startswith(SLOW)])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderkey" in plan(spark, "id_range_filter")
    assert "GreaterThanOrEqual(ts" in plan(spark, "time_slice")
    assert "In(event_type" in plan(spark, "exclude_types")


def test_columns_are_pruned(spark):
    text = plan(spark, "ads_order_funnel_day")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz" \
        in text and "o_totalprice" not in text


def test_shuffles(spark):
    assert plan(spark, "dws_trade_user_day").count("Exchange hashpartitioning") == 1
    assert plan(spark, "dws_user_lifetime").count("Exchange hashpartitioning") == 1
    # the report adds one small shuffle of day sums
    assert plan(spark, "ads_trade_overview_day").count("Exchange hashpartitioning") == 2
    assert plan(spark, "latest_per_key").count("Exchange hashpartitioning") == 1
