from pyspark.sql import functions as F

from loyalframe.operators.retention import monthly_retention_rate, pool_vs_retention
from loyalframe.operators.segments import pivot_loyalty_tier
from loyalframe.plans.pipeline import LoyaltyData
from tests.fixtures import EXPECTED_CUSTOMERS, EXPECTED_RETENTION, customer_lines, labels


def _data(spark):
    return LoyaltyData(customer_lines(spark), labels(spark))


def test_customer_rules(spark):
    d = _data(spark)
    rows = d.customers.select(
        "Buyer_Username", "Num_of_Orders", "Num_of_Canceled_Orders", "Average_Purchase_Value", "Loyalty_Tier",
        "Funnel_Group", "Switching_Status", "Days_To_Switch").collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert got == EXPECTED_CUSTOMERS


def test_switching_time_only_for_switchers(spark):
    d = _data(spark)
    bad = d.customers.where((F.col("Switching_Status") == "Switcher") != F.col("Switching_Ts").isNotNull())
    assert bad.count() == 0
    assert d.customers.where(F.col("Days_To_Switch") < 0).count() == 0


def test_three_way_tie_option(spark):
    from loyalframe.config import LoyaltyConfig

    d = LoyaltyData(customer_lines(spark), labels(spark), LoyaltyConfig(three_way_ties_first=True))
    r = d.customers.where(F.col("Buyer_Username") == "f_krs").select("Funnel_Group", "Switching_Status").first()
    assert tuple(r) == ("Start with all 3 brands", "Start with all 3 brands")


def test_tier_invariants(spark):
    d = _data(spark)
    p = pivot_loyalty_tier(d.customers).collect()
    assert sum(r.Num_Of_Customers for r in p) == len(EXPECTED_CUSTOMERS)
    assert abs(sum(r.Pct_Num_Of_Customers for r in p) - 100) < 0.05


def test_retention(spark):
    d = _data(spark)
    got = sorted(tuple(r) for r in monthly_retention_rate(d.monthly).collect())
    assert got == EXPECTED_RETENTION
    # every buyer is new exactly once
    assert sum(r[1] for r in got) == len(EXPECTED_CUSTOMERS)
    pools = [r[2] for r in got]
    assert pools == sorted(pools)


def test_pool_with_gap_month(spark):
    # March has no new buyers, so April's pool is undefined and April drops out
    got = {r.Order_Month: (r.Legacy_Pool, r.Retention_Rate) for r in pool_vs_retention(_data(spark).monthly).collect()}
    assert got == {"2026-02": (8, 12.5), "2026-03": (16, 18.75)}


def test_checkpointed_graph_matches(spark):
    # cutting lineage at lines and orders changes nothing in the results
    plain = _data(spark)
    fixed = LoyaltyData(plain.raw_lines, plain.labels).checkpoint(lines=True)
    a = sorted(tuple(r) for r in pivot_loyalty_tier(plain.customers).collect())
    b = sorted(tuple(r) for r in pivot_loyalty_tier(fixed.customers).collect())
    assert a == b


def test_hot_pseudo_buyer(spark):
    # one key holding most orders: results stay whole and exact
    from tests.fixtures import LINE_SCHEMA, line, t

    rows = [line(f"h{i}", "K" if i % 2 else "R", t("2026-01-01 10:00"), None) for i in range(3000)]
    rows += [line("x1", "S", t("2026-01-02 10:00"), "solo")]
    d = LoyaltyData(spark.createDataFrame(rows, LINE_SCHEMA), labels(spark))
    got = {r.Buyer_Username: (r.Num_of_Orders, r.Funnel_Group) for r in d.customers.collect()}
    assert got == {"No Username": (3000, "Start with Kinka and Revy"), "solo": (1, "Only with SiMee")}


def _funnel_both_ways(d):
    # the one-pass monthly funnel, and the join of the month x buyer table
    # to the switch months of the customer table (brute force)
    from loyalframe.functions import month_text
    from loyalframe.operators.adhoc import monthly_funnel

    got = sorted((tuple(r) for r in monthly_funnel(d.orders).collect()), key=str)
    m = d.monthly.groupBy(F.col("Order_Month").alias("Month")).agg(
        F.count("*").alias("t"),
        F.count(F.when(F.col("Acquisition_Type") == "Return From Previous Month", 1)).alias("r"))
    s = d.customers.where(F.col("Switching_Status") == "Switcher").groupBy(
        month_text("Switching_Ts").alias("Month")).agg(F.count("*").alias("s"))
    want = sorted((tuple(r) for r in m.join(s, "Month", "left").select(
        "Month", "t", "r", F.coalesce("s", F.lit(0))).collect()), key=str)
    return got, want


def test_monthly_funnel_matches_join_form(spark):
    # hand fixture: pseudo buyer, pair and three-way entries, later switches
    got, want = _funnel_both_ways(_data(spark))
    assert got == want
    assert sum(r[3] for r in got) == 5  # f_k_r, f_kr_s, f_krs, f_rs_k, f_s_kr


def test_monthly_funnel_orders_without_time(spark):
    # an order whose time did not parse keeps its buyer in a NULL month
    lines = customer_lines(spark)
    no_time = (lines.where(F.col("Buyer_Username") == "t_one")
               .withColumn("Created_At", F.lit(None).cast("timestamp")).withColumn("Order_ID", F.lit("zz")))
    got, want = _funnel_both_ways(LoyaltyData(lines.unionByName(no_time), labels(spark)))
    assert got == want
    assert (None, 1, 0, 0) in got


def test_active_between_matches_semi_join(spark):
    # brute force: the customer rows of buyers with an order in the window,
    # by a semi-join of the order table, on the hand fixture; the window
    # is half-open, so orders at midnight on 2026-02-01 are in and orders
    # at midnight on 2026-03-01 are out
    from loyalframe.operators.adhoc import customers_active_between
    from loyalframe.operators.customers import total_customers_data

    d = _data(spark)
    got = customers_active_between(d.orders, "2026-02-01", "2026-03-01")
    ts = F.col("Order_Ts")
    active = d.orders.where((ts >= F.lit("2026-02-01").cast("timestamp")) & (ts < F.lit("2026-03-01").cast("timestamp")))
    want = total_customers_data(d.customers).join(active.select("Buyer_Username"), "Buyer_Username", "left_semi")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    names = {r[0] for r in got.select("Buyer_Username").collect()}
    assert "No Username" in names and "f_none" in names and "f_kr" in names and "t_one" not in names
