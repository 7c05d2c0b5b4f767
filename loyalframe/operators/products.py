"""A6, A12 — product-level monthly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import month_text
from loyalframe.functions.exprs import whole_ratio
from loyalframe.operators.labelling import named_buyer_lines, non_gift_lines

PRODUCT_KEYS = ("Month_Year", "Product_SKU_Name", "Product_Variant")


def _round2(c, dtype):
    # ROUND(x, 2) is a no-op on whole numbers; keep their integer type
    return c if isinstance(dtype, IntegralType) else F.round(c, 2)


def pivot_monthly_products(lines: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per month x SKU name x category x variant: revenue, units, volume,
    and the same for non-sample lines, joined back on (month, name, variant).

    One aggregation computes both the all-lines and the non-sample measures
    (conditional sums), so the order lines are shuffled once; it keys on
    the sub-category too, so the line-level aggregate is a hash aggregate
    and only the (small) aggregated rows pick one sub-category, with one
    more exchange of those rows for everything after. The
    non-sample measures are matched on the shop's key without Category: a
    (month, name, variant) sold under two categories pairs every category
    row with every non-sample category row (m x n rows), as the shop's
    join did; missing matches read 0.
    """
    nonaff = F.col("Normal_Or_Pre_order").isNotNull()
    q, after, pack = F.col("Quantity"), F.col("SKU_Subtotal_After_Discount"), F.col("Pack_Size")
    keys = ["Month_Year", "Product_SKU_Name", "Category", "Product_Variant"]
    measures = ["Total_Merchanise_Value", "Affiliated_Num_Of_Unit_Sold", "_vol", "_n_nonaff", "_q_nonaff",
                "_v_nonaff", "_rev_nonaff"]
    # level 1: hash aggregate of the lines, sub-category as a key (numeric buffers only)
    fine = (
        non_gift_lines(lines, cfg)
        .withColumn("Month_Year", month_text("Created_At"))
        .groupBy(*keys, "Sub_category")
        .agg(
            F.sum(after).alias(measures[0]),
            F.sum(q).alias(measures[1]),
            F.sum(pack).alias(measures[2]),
            F.count(F.when(nonaff, 1)).alias(measures[3]),
            F.sum(F.when(nonaff, q)).alias(measures[4]),
            F.sum(F.when(nonaff, pack)).alias(measures[5]),
            F.sum(F.when(nonaff, after)).alias(measures[6]),
        )
    )
    # level 2, on the aggregated rows: one row per category (its largest
    # sub-category, summed measures). The rows are hash-partitioned once by
    # the product key (month, name, variant) — aggregated rows, a handful
    # per product, so no hot key — and that one partitioning serves both
    # the per-category windows here and the product window below.
    # All window functions share one ordering: (month, name, variant,
    # category, sub-category desc) — its prefix is the product window's
    # ordering too, so the three windows need a single sort.
    cat = Window.partitionBy(*PRODUCT_KEYS, "Category").orderBy(F.col("Sub_category").desc_nulls_last())
    whole = cat.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    agg = (
        fine.repartition(*PRODUCT_KEYS)
        .select(*keys, F.max("Sub_category").over(whole).alias("Sub_category"),
                *[F.sum(m).over(whole).alias(m) for m in measures],
                F.row_number().over(cat).alias("_r"))
        .where(F.col("_r") == 1)
        .drop("_r")
    )
    t = {f.name: f.dataType for f in agg.schema.fields}
    # the non-sample side of the shop's join: every category row of the same
    # (month, name, variant) that has non-sample lines. The window runs on
    # aggregated rows; its list holds one entry per category of a product
    # in a month, so it is bounded by the category vocabulary, not by lines.
    cand = F.struct(
        F.coalesce(F.col("_q_nonaff"), F.lit(0)).alias("units"),
        _round2(F.coalesce(F.col("_v_nonaff"), F.lit(0)), t["_v_nonaff"]).alias("volume"),
        whole_ratio("_rev_nonaff", "_q_nonaff", t["_rev_nonaff"], t["_q_nonaff"], cfg.truncate_integer_ratio)
        .alias("price"),
    )
    w = Window.partitionBy(*PRODUCT_KEYS)
    keys_known = F.col("Month_Year").isNotNull() & F.col("Product_SKU_Name").isNotNull() & F.col(
        "Product_Variant").isNotNull()
    matches = F.when(keys_known, F.collect_list(F.when(F.col("_n_nonaff") > 0, cand)).over(w))
    j = agg.select(
        "Month_Year", "Category", "Sub_category", "Product_SKU_Name", "Product_Variant",
        "Total_Merchanise_Value", "Affiliated_Num_Of_Unit_Sold",
        _round2(F.col("_vol"), t["_vol"]).alias("Affiliated_Volume_Sold"),
        matches.alias("_matches"),
    )
    j = j.select(*[c for c in j.columns if c != "_matches"], F.explode_outer("_matches").alias("_t2"))
    units = F.coalesce(F.col("_t2.units"), F.lit(0))
    return j.select(
        *[c for c in j.columns if c != "_t2"],
        units.alias("Nonaffiliated_Num_Of_Unit_Sold"),
        (F.col("Affiliated_Num_Of_Unit_Sold") - units).alias("Num_Of_Affiliate_Sample_Unit"),
        F.coalesce(F.col("_t2.volume"), F.lit(0)).alias("Nonaffiliated_Volume_Sold"),
        F.coalesce(F.col("_t2.price"), F.lit(0)).alias("Nonaffiliated_Avg_Price"),
    )


def monthly_sku_sales(lines: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """Lines and revenue per SKU name x month (non-gift, named buyers)."""
    return (
        named_buyer_lines(non_gift_lines(lines, cfg))
        .withColumn("Month_Year", month_text("Created_At"))
        .groupBy("Product_SKU_Name", "Month_Year")
        .agg(F.count(F.lit(1)).alias("Num_Of_Lines"),
             F.sum("SKU_Subtotal_After_Discount").alias("Total_Merchandise_Value"))
    )
