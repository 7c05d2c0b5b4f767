"""Small fixtures per edge (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from loyalframe.functions import pct, week_ending
from loyalframe.operators.labelling import dedupe_labels, flag_gifts, label_order_lines, missing_label_ids
from loyalframe.operators.products import pivot_monthly_products
from loyalframe.plans.pipeline import LoyaltyData
from tests.fixtures import LABEL_SCHEMA, LINE_SCHEMA, line, t


def _lines(spark, rows):
    return spark.createDataFrame(rows, LINE_SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def test_duplicate_label_last_wins(spark):
    lab = _labels(spark, [("A", "c", "s", "n", "v", "Kinka", 1), ("A", "c", "s", "n", "v", "Revy", 1)]).coalesce(1)
    ls = _lines(spark, [line("o1", "A", t("2026-01-01"), "b")])
    out = label_order_lines(ls, lab).collect()
    assert len(out) == 1 and out[0].Brand == "Revy"


def test_blank_and_spaced_ids(spark):
    lab = _labels(spark, [(" A ", "c", "s", "n", "v", "Kinka", 1), ("", "c", "s", "n", "v", "Revy", 1)])
    assert [r.ID for r in dedupe_labels(lab).collect()] == ["A"]
    ls = _lines(spark, [line("o1", "A ", t("2026-01-01"), "b")])
    assert label_order_lines(ls, lab).first().Brand == "Kinka"


def test_missing_ids(spark):
    lab = _labels(spark, [("A", "c", "s", "n", "v", "Kinka", 1)])
    ls = _lines(spark, [line(f"o{i}", k, t("2026-01-01"), "b") for i, k in enumerate(["Z", "Z", "", None, "A"])])
    assert sorted(r.Missing_ID for r in missing_label_ids(ls, lab).collect()) == ["", "Z", "Z"]


def test_gift_rule(spark):
    ls = _lines(spark, [
        line("o1", "A", t("2026-01-01"), "b", before=0),
        line("o2", "A", t("2026-01-01"), "b", before=0, normal=None),
        line("o3", "A", t("2026-01-01"), "b", before=5),
    ]).withColumn("Category", F.lit("c"))
    got = {r.Order_ID: r.Category for r in flag_gifts(ls).collect()}
    assert got == {"o1": "Quà tặng", "o2": "c", "o3": "c"}


def test_product_fan_out_and_samples(spark):
    lab = _labels(spark, [("A", "c1", "s", "n", "v", "Kinka", 2), ("B", "c2", "s", "n", "v", "Kinka", 3),
                          ("C", "c3", "s", "m", "v", "Revy", 1), ("D", "c4", "s", "z", "v", "Revy", 1)])
    ls = _lines(spark, [
        line("o1", "A", t("2026-01-01"), "b", qty=2, after=50),
        line("o2", "B", t("2026-01-02"), "b", qty=1, after=30),
        line("o3", "C", t("2026-01-02"), "b", qty=4, normal=None),  # affiliate-only SKU
        line("o4", "D", t("2026-01-02"), "b", qty=0, after=70),     # zero quantity
    ])
    rows = pivot_monthly_products(LoyaltyData(ls, lab).lines).collect()
    n_rows = [r for r in rows if r.Product_SKU_Name == "n"]
    assert len(n_rows) == 4  # 2 categories x 2 non-sample category rows
    m = [r for r in rows if r.Product_SKU_Name == "m"][0]
    assert (m.Nonaffiliated_Num_Of_Unit_Sold, m.Num_Of_Affiliate_Sample_Unit, m.Nonaffiliated_Avg_Price) == (0, 4, 0)
    z = [r for r in rows if r.Product_SKU_Name == "z"][0]
    assert z.Nonaffiliated_Avg_Price == 0


def test_no_labelled_lines_no_error(spark):
    lab = _labels(spark, [("A", "c", "s", "n", "v", "Kinka", 1)])
    ls = _lines(spark, [line("o1", "Z", t("2026-01-01"), "b")])
    r = LoyaltyData(ls, lab).customers.first()
    assert r.Basket_Pct_Kinka_Products is None and r.Funnel_Group == "Not buy any of 3 brands"


def test_week_labels(spark):
    df = spark.createDataFrame([(t("2026-01-05 13:00"),), (t("2026-01-06 00:00"),), (t("2026-01-19 23:59"),)], "ts timestamp")
    mon = [str(r[0]) for r in df.select(week_ending("ts", "MON")).collect()]
    sun = [str(r[0]) for r in df.select(week_ending("ts", "SUN")).collect()]
    assert mon == ["2026-01-05", "2026-01-12", "2026-01-19"]
    assert sun == ["2026-01-11", "2026-01-11", "2026-01-25"]


def test_exact_rounding(spark):
    df = spark.createDataFrame([(1, 800), (1, 8), (2, 3), (0, 0)], "a long, b long")
    half_even = [r[0] for r in df.select(pct("a", "b", 2, half_even=True)).collect()]
    half_up = [r[0] for r in df.select(pct("a", "b", 2)).collect()]
    assert half_even == [0.12, 12.5, 66.67, None]
    assert half_up == [0.13, 12.5, 66.67, None]
