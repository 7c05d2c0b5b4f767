"""A4 — one row per month x buyer (``monthly_customers_data``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import days_from_minutes, minute_text, minutes_between, month_text, pct, ratio, round_div
from loyalframe.operators.orders import brand_measures


def monthly_frame(orders: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """Month x buyer aggregate, lifetime first/last seen, new vs returning.

    The aggregate runs first (map-side partial, shuffle on month x
    buyer); the lifetime window then partitions the aggregated rows by
    buyer, so a buyer contributes at most one row per month to it —
    including the pseudo buyer of buyer-less orders.
    """
    n_cols, s_cols, k_cols = brand_measures(cfg)
    ts = F.col("Order_Ts")
    aggs = [
        F.count("Order_ID").alias("Num_of_Orders"),
        F.count(F.when(F.col("Order_Status") == cfg.cancelled_status, 1)).alias("Num_of_Canceled_Orders"),
        F.min(ts).alias("First_Seen_In_Month_Ts"),
        F.max(ts).alias("Last_Seen_In_Month_Ts"),
        F.sum("Order_Amount").alias("Total_Customer_Spending"),
        F.sum("Sum_SKU_Subtotal_After_Discount").alias("Merchandise_Value"),
    ]
    aggs += [F.sum(c).alias(c) for c in n_cols + s_cols + k_cols]
    g = orders.withColumn("Order_Month", month_text(ts)).groupBy("Order_Month", "Buyer_Username").agg(*aggs)
    t = {f.name: f.dataType for f in g.schema.fields}
    w = Window.partitionBy("Buyer_Username")
    total = sum((F.col(c) for c in n_cols[1:]), F.col(n_cols[0]))
    g = g.withColumns({
        "Lifetime_First_Seen_Ts": F.min("First_Seen_In_Month_Ts").over(w),
        "Lifetime_Last_Seen_Ts": F.max("Last_Seen_In_Month_Ts").over(w),
        "Average_Purchase_Value": ratio("Total_Customer_Spending", "Num_of_Orders",
                                        t["Total_Customer_Spending"], t["Num_of_Orders"],
                                        cfg.truncate_integer_ratio),
        "Basket_Total_Num_Products": total,
    })
    first, life = F.col("First_Seen_In_Month_Ts"), F.col("Lifetime_First_Seen_Ts")
    start = ("CASE WHEN First_Seen_In_Month_Ts IS NOT NULL AND Lifetime_First_Seen_Ts IS NOT NULL"
             " THEN least(First_Seen_In_Month_Ts, Lifetime_First_Seen_Ts) END")
    g = g.withColumns({
        "Avg_Basket_Size": round_div("Basket_Total_Num_Products", "Num_of_Orders", 2),
        "Retention_Minutes": minutes_between("Last_Seen_In_Month_Ts", start),
        **{f"Basket_Pct_{s}_Products": pct(n, "Basket_Total_Num_Products", 2)
           for (_, s), n in zip(cfg.brands, n_cols)},
        "Acquisition_Type": F.when(month_text(life) < month_text(first), F.lit(C.ACQ_RETURNING))
        .otherwise(F.lit(C.ACQ_NEW)),
    })
    return g.withColumn("Retention_Time_Period", days_from_minutes("Retention_Minutes"))


def monthly_customers_data(monthly: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    n_cols, s_cols, k_cols = brand_measures(cfg)
    return monthly.select(
        "Order_Month", "Buyer_Username", "Num_of_Orders", "Num_of_Canceled_Orders",
        minute_text("Lifetime_First_Seen_Ts").alias("Lifetime_First_Seen"),
        minute_text("First_Seen_In_Month_Ts").alias("First_Seen_In_Month"),
        minute_text("Lifetime_Last_Seen_Ts").alias("Lifetime_Last_Seen"),
        minute_text("Last_Seen_In_Month_Ts").alias("Last_Seen_In_Month"),
        "Total_Customer_Spending", "Merchandise_Value", "Average_Purchase_Value",
        *n_cols, "Basket_Total_Num_Products", "Avg_Basket_Size", *s_cols, *k_cols,
        "Retention_Time_Period", *[f"Basket_Pct_{s}_Products" for _, s in cfg.brands], "Acquisition_Type",
    )


def returning_customers(monthly: DataFrame) -> DataFrame:
    """Month x buyer rows of returning buyers."""
    return monthly.where(F.col("Acquisition_Type") == C.ACQ_RETURNING)
