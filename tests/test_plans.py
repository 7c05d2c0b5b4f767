"""Physical-plan properties the datasets are designed for."""

import re

import pytest

from loyalframe.plans.registry import DATASETS

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["total_orders_data", "total_customers_data", "monthly_customers_data",
                                  "pivot_loyalty_tier", "monthly_sku_sales"])
def test_line_level_aggregates_are_hash_aggregates(spark, name):
    plan = _plan(spark, name)
    # sort-based aggregates: only the label de-duplication (max_by of a struct)
    for m in re.finditer(r"SortAggregate\(key=\[([^\]]*)\]", plan):
        assert m.group(1).startswith("ID#"), m.group(0)
    assert re.search(r"HashAggregate\(keys=\[Order_ID#\d+, Order_Amount#", plan) or name == "monthly_sku_sales"


def test_no_cartesian_products(spark):
    import __spark_entry__ as E

    for name in DATASETS:
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_second_purchase_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in _plan(spark, "second_purchase")


def test_products_scan_lines_once(spark):
    plan = _plan(spark, "pivot_monthly_products")
    assert plan.count("FileScan parquet") <= 4  # lineitem, orders, part (lines), part (labels)
    assert "SortMergeJoin" not in plan


def test_label_join_is_broadcast_at_small_scale(spark):
    plan = _plan(spark, "total_orders_data")
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan


def test_spread_partitioning_feeds_order_aggregate(spark):
    # on demand the line scan is hash-spread on Order_ID; both levels of the
    # order aggregate reuse that partitioning instead of shuffling again
    assert "REPARTITION_BY_NUM" not in _plan(spark, "total_orders_data")
    spark.conf.set("spark.loyalframe.linePartitions", "8")
    try:
        plan = _plan(spark, "total_orders_data")
    finally:
        spark.conf.unset("spark.loyalframe.linePartitions")
    assert re.search(r"Exchange hashpartitioning\(Order_ID#\d+, \d+\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"Exchange hashpartitioning\(Order_ID#\d+, Order_Amount", plan)


def test_active_buyers_in_one_pass(spark):
    # "has an order in the window" is a per-buyer aggregate of the customer
    # pass: no join on the buyer, the lines are derived once
    plan = _plan(spark, "customers_active_between")
    assert "LeftSemi" not in plan
    assert plan.count("FileScan parquet") <= 4


def test_hist_by_month_broadcasts_month_range(spark):
    plan = _plan(spark, "first_seen_hist_by_month")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_broadcast_plan_reuses_join_partitioning(spark):
    # at scale neither orders nor part nor the labels fit a broadcast; the
    # join keys are chosen so the label join reuses the part join's
    # partitioning, and the order aggregate reuses the orders join's: the
    # lines are shuffled once by product id and once by order id
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = _plan(spark, "total_orders_data")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"SortMergeJoin \[trim\(SKU_ID#\d+, None\)\]", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(trim\(SKU_ID", plan)) == 1
    assert "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(l_partkey" not in plan
    # the orders join comes last, on Order_ID: the order aggregate reuses it
    assert re.search(r"SortMergeJoin \[Order_ID#\d+\], \[_o_id#\d+\], Inner", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(Order_ID#", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\(Order_ID#\d+, Order_Amount", plan)


@pytest.mark.parametrize("name", ["switch_total_funnel_group", "switch_total_funnel_group_by_status"])
def test_funnel_group_labels_picked_after_hash_aggregate(spark, name):
    # buyers are hash-aggregated per (group, status, tier); the string max
    # of the labels shown beside a group runs on those few rows only
    plan = _plan(spark, name)
    assert re.search(r"HashAggregate\(keys=\[Funnel_Group#\d+, Switching_Status#\d+, Loyalty_Tier#\d+\]", plan)
    for m in re.finditer(r"SortAggregate\(key=\[([^\]]*)\]", plan):
        assert m.group(1).startswith(("ID#", "Funnel_Group#")), m.group(0)


def test_monthly_funnel_in_one_pass(spark):
    plan = _plan(spark, "monthly_funnel")
    assert "Join" not in plan.replace("BroadcastHashJoin", "")  # only the line-level lookups
    assert plan.count("FileScan parquet") <= 4


def test_products_one_exchange_after_line_aggregate(spark):
    # aggregated rows are partitioned once by (month, name, variant); the
    # per-category collapse and the product window share it and one sort
    plan = _plan(spark, "pivot_monthly_products")
    assert len(re.findall(r"Exchange hashpartitioning\(Month_Year#", plan)) == 2
    assert not re.search(r"SortAggregate\(key=\[Month_Year", plan)
    assert len(re.findall(r"Sort \[Month_Year#", plan)) == 1


@pytest.mark.parametrize("name", ["first_seen_hist", "first_seen_hist_by_month"])
def test_histogram_range_reuses_the_shuffles_at_run_time(spark, name):
    # the range (a scalar subquery / a broadcast side) is a second subtree
    # over the same rows; adaptive execution runs its shuffles only once
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final and "ReusedExchange" in final


def test_cluster_broadcast_bounds():
    # static estimates (compressed file sizes) get the small bound; the
    # large one only applies to sizes AQE measured at run time
    from loyalframe.session import cluster_conf

    c = cluster_conf(100 * 1024**4)
    static = int(c["spark.sql.autoBroadcastJoinThreshold"])
    measured = int(c["spark.sql.adaptive.autoBroadcastJoinThreshold"])
    assert static <= 64 * 1024**2 < measured <= 512 * 1024**2
    assert int(c["spark.sql.shuffle.partitions"]) >= 100_000
    # stacked joins on one partitioning still get their skewed partitions split
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert c["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"
