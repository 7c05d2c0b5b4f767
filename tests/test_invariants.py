"""Invariants of the datasets on the benchmark tables and exact rounding."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from loyalframe.functions import pct, round_div
from loyalframe.operators import retention, segments
from loyalframe.plans.pipeline import LoyaltyData

SF = "/root/testdata/sf0.01"


def test_dataset_invariants(spark):
    d = LoyaltyData.from_tables(spark, SF)
    buyers = d.customers.count()
    tiers = segments.pivot_loyalty_tier(d.customers).collect()
    assert sum(r.Num_Of_Customers for r in tiers) == buyers
    assert abs(sum(r.Pct_Num_Of_Customers for r in tiers) - 100) <= 0.01 * len(tiers)
    # every buyer is new exactly once; the pool never shrinks
    ret = retention.monthly_retention_rate(d.monthly).orderBy("Order_Month").collect()
    assert sum(r.New_Customers for r in ret) == buyers
    pools = [r.Legacy_Pool for r in ret]
    assert pools == sorted(pools)
    # switchers have a non-negative time to switch; nobody else has one
    sw = d.customers.where(F.col("Switching_Status") == "Switcher")
    assert sw.where(F.col("Days_To_Switch").isNull() | (F.col("Days_To_Switch") < 0)).count() == 0
    assert d.customers.where((F.col("Switching_Status") != "Switcher") & F.col("Days_To_Switch").isNotNull()).count() == 0
    # labelling keeps every line; orders carry every line's money
    assert d.lines.count() == d.raw_lines.count()
    tot = d.raw_lines.agg(F.sum("SKU_Subtotal_After_Discount")).first()[0]
    assert d.orders.agg(F.sum("Sum_SKU_Subtotal_After_Discount")).first()[0] == tot
    # monthly shares sum to 100 within each month (up to rounding)
    acq = segments.pivot_monthly_customers_acquisition(d.monthly)
    bad = acq.groupBy("Order_Month").agg(F.sum("Pct_Num_Of_Customers").alias("s")).where(F.abs(F.col("s") - 100) > 0.02)
    assert bad.count() == 0


def _ref_round(p: int, q: int, scale: int, half_even: bool) -> float:
    x = Fraction(p, q) * 10**scale
    n, r = divmod(abs(x.numerator), x.denominator)
    twice = 2 * r
    if twice > x.denominator or (twice == x.denominator and (not half_even or n % 2 == 1)):
        n += 1
    return (n if x >= 0 else -n) / 10**scale


def test_exact_rounding_random(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(-10**12, 10**12), rnd.randint(1, 10**6)) for _ in range(3000)]
    rows += [(1, 800), (1, 8), (5, 1000), (-5, 1000), (1005, 1000), (3, 200)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", round_div("a", "b", 2).alias("s"), round_div(F.col("a"), F.col("b"), 3).alias("c"),
                    pct("a", "b", 2, half_even=True).alias("e")).collect()
    for r in got:
        assert r.s == _ref_round(r.a, r.b, 2, False), r
        assert r.c == _ref_round(r.a, r.b, 3, False), r
        if r.a >= 0:
            assert r.e == _ref_round(r.a * 100, r.b, 2, True), r


def test_reordered_adapter_lines_equal_generic_labelling(spark):
    # the benchmark graph labels lines with the product joins first and the
    # orders join last; the result must equal labelling the adapter's lines
    from loyalframe.operators.labelling import flag_gifts, prepared_lines
    from loyalframe.sources.adapter import (
        labelled_order_lines_from_tables, order_lines_from_tables, product_labels_from_tables,
    )

    sf = "/root/testdata/sf0.001"
    labels = product_labels_from_tables(spark, sf)
    generic = prepared_lines(order_lines_from_tables(spark, sf), labels)
    reordered = flag_gifts(labelled_order_lines_from_tables(spark, sf, labels))
    assert generic.schema == reordered.schema
    assert generic.exceptAll(reordered).count() == 0 and reordered.exceptAll(generic).count() == 0
    assert reordered.count() == generic.count() > 0
