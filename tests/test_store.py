"""Stored layout (months, buyer buckets), hot products in the label join, CSV in input order."""

import csv
import re
import statistics

import pytest
from pyspark.sql import functions as F

from loyalframe.operators.labelling import hot_product_ids, label_order_lines
from loyalframe.plans.pipeline import LoyaltyData
from loyalframe.plans.registry import DATASETS
from loyalframe.plans.store import store
from loyalframe.sources.ingest import EXPORT_ORDER, cast_order_lines, read_raw_export
from loyalframe.sources.sinks import write_labelled_csv
from tests.fixtures import LABEL_SCHEMA, LINE_SCHEMA, line, t
from tests.test_io import HEADER

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return store(LoyaltyData.from_tables(spark, SF), str(tmp_path_factory.mktemp("store")), buckets=4)


@pytest.mark.parametrize("name", ["label_order_lines", "total_orders_data", "total_customers_data", "monthly_customers_data",
                                  "second_purchase", "customers_active_between", "subcategory_month_lines",
                                  "sku_weekly_line_counts", "sku_weekly_price", "pivot_monthly_products"])
def test_stored_layout_gives_the_same_rows(spark, stored, name):
    got, want = DATASETS[name](stored), DATASETS[name](LoyaltyData.from_tables(spark, SF))
    assert got.columns == want.columns
    exact = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(map(exact, got.collect())) == sorted(map(exact, want.collect()))


@pytest.mark.parametrize("name", ["total_customers_data", "monthly_customers_data", "second_purchase", "customers_active_between"])
def test_named_buyers_are_read_without_an_exchange(stored, name):
    only = type(stored).__new__(type(stored))
    only.__dict__.update({k: v for k, v in stored.__dict__.items() if k not in ("customers", "monthly", "orders")})
    only.by_buyer = lambda build: build(stored.named_orders)
    plan = _plan(DATASETS[name](only))
    assert "Exchange hashpartitioning" not in plan and "Exchange Single" not in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("name", ["subcategory_month_lines", "sku_weekly_line_counts", "sku_weekly_price", "customers_active_between"])
def test_only_the_months_in_question_are_opened(stored, name):
    assert re.search(r"PartitionFilters: \[[^\]]*Order_Month", _plan(DATASETS[name](stored)))


def test_a_hot_product_is_dealt_over_all_tasks(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    lines = spark.range(40_000).select(
        F.concat(F.lit("o"), F.col("id")).alias("Order_ID"),
        F.when(F.col("id") % 2 == 0, " hot ").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("p"), F.col("id") % 500)).alias("SKU_ID"), F.lit("x").alias("Category"))
    rows = [(f"p{i}", "c", "s", "n", f"v{i}", "Kinka", i) for i in range(0, 500, 3)] + [("hot", "c", "s", "n", "v", "Revy", 1)]
    labels = spark.createDataFrame(rows, LABEL_SCHEMA)
    try:
        spark.conf.set(keys[0], "-1"), spark.conf.set(keys[1], "-1"), spark.conf.set(keys[2], "false"), spark.conf.set(keys[3], "16")
        hot = hot_product_ids(lines, 0.1)
        assert hot == ("hot",)
        plain, dealt = label_order_lines(lines, labels, flag="Has"), label_order_lines(lines, labels, flag="Has", hot_ids=hot)
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)).alias("count"), F.count("Brand")).collect()]
        assert max(sizes(plain)) > 5 * statistics.median(sizes(plain))
        # lines without a product id still share one task: they are a seventh of the rest here
        spread = sizes(dealt.where("SKU_ID IS NOT NULL"))
        assert max(spread) < 2 * statistics.median(spread) and len(spread) == 16
        key = lambda r: tuple(str(x) for x in r)
        assert dealt.columns == plain.columns
        assert sorted(map(tuple, dealt.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_products_change_no_dataset(spark):
    rows = [line(f"o{i}", "K" if i % 2 else "R", t("2026-01-05 10:00"), "ann") for i in range(20)]
    from tests.fixtures import labels

    lines = spark.createDataFrame(rows, LINE_SCHEMA)
    a, b = LoyaltyData(lines, labels(spark)), LoyaltyData(lines, labels(spark), hot_share=0.3)
    assert b.hot_ids == ("K", "R") and a.customers.collect() == b.customers.collect()


def test_csv_in_the_order_of_the_exports(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    want = []
    for name in ("a", "b", "c"):
        rows = [[f"{name}{i}", "x", "Normal", "05/01/2026 10:00:31", "ann", "K1", str(i % 9), "1", "1", "1", "0", "1"] for i in range(400, 0, -1)]
        want += [r[0] for r in rows]
        with open(src / f"{name}.csv", "w", newline="", encoding="utf-8") as fh:
            csv.writer(fh).writerows([HEADER, *rows])
    raw = read_raw_export(spark, str(src), ordinal=True)
    labels = spark.createDataFrame([("K1", "c", "s", "n", "v", "Kinka", 1)], LABEL_SCHEMA)
    lines = label_order_lines(cast_order_lines(raw), labels)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts from few rows
    try:
        write_labelled_csv(lines, str(tmp_path / "out"), order_by=EXPORT_ORDER)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "out").glob("part-*"))
    got = []
    for p in parts:
        with open(p, newline="", encoding="utf-8") as fh:
            rows = list(csv.reader(fh))
        assert "Export_Row" not in rows[0]
        got += [r[0] for r in rows[1:]]
    assert got == want and len(parts) > 1


SUMMARIES = ("pivot_loyalty_tier", "switch_total_switching_status", "switch_monthly_switching_status_loyal",
             "switch_total_funnel_group", "switch_total_funnel_group_by_status", "switch_monthly_funnel_group",
             "switch_monthly_funnel_group_switcher", "loyal_status_share", "entry_month_by_tier", "funnel_ltv_rank",
             "monthly_funnel_stack")


def test_summaries_from_one_pass_over_the_buyers(spark):
    from tests.fixtures import customer_lines, labels

    for make in (lambda: LoyaltyData.from_tables(spark, SF), lambda: LoyaltyData(customer_lines(spark), labels(spark))):
        single, once = make(), make().write_cube()
        for name in SUMMARIES:
            got, want = DATASETS[name](once), DATASETS[name](single)
            assert got.dtypes == want.dtypes, name
            key = lambda r: tuple(str(x) for x in r)
            assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key), name
            assert got.inputFiles() and all("customer_cube" in f for f in got.inputFiles()), name
