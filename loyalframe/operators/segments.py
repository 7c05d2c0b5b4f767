"""A3 / A5 — customer segment summaries (``pivot_loyalty_tier``,
``pivot_monthly_customers_acquisition``).

Both group a per-buyer (or per month x buyer) frame by a segment and put
each segment's count and spend beside its share of the total. The share
denominators are window sums over the already aggregated segment rows
(a handful per month), so the window never sees raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import pct, ratio, round_div
from loyalframe.functions.exprs import integer_rule, whole_ratio
from loyalframe.operators.cube import is_cube, roll_up
from loyalframe.operators.orders import brand_measures


SEGMENT_SUMS = ("Num_Of_Customers", "Total_Customer_Spending", "Num_of_Orders", "_canceled", "_period_min", "_period_n")


def segment_aggs(cfg: LoyaltyConfig):
    """The additive measures of a segment of buyers: ``SEGMENT_SUMS`` and the brand measures."""
    n_cols, s_cols, k_cols = brand_measures(cfg)
    aggs = [
        F.count("Buyer_Username").alias("Num_Of_Customers"),
        F.sum("Total_Customer_Spending").alias("Total_Customer_Spending"),
        F.sum("Num_of_Orders").alias("Num_of_Orders"),
        F.sum("Num_of_Canceled_Orders").alias("_canceled"),
        F.sum("Retention_Minutes").alias("_period_min"),
        F.count("Retention_Minutes").alias("_period_n"),
    ]
    aggs += [F.sum(c).alias(c) for c in n_cols + s_cols + k_cols]
    return aggs


def _brand_ratios(g: DataFrame, cfg: LoyaltyConfig) -> dict:
    n_cols, s_cols, k_cols = brand_measures(cfg)
    t = {f.name: f.dataType for f in g.schema.fields}
    out = {}
    for (_, s), n, sp, k in zip(cfg.brands, n_cols, s_cols, k_cols):
        out[f"Basket_Avg_{s}_Packsize"] = _packsize_avg(k, n, t, cfg)
        out[f"Basket_Pct_{s}_Products"] = pct(n, "Basket_Total_Num_Products", 2)
        out[f"Basket_Avg_Spend_On_{s}"] = ratio(sp, n, t[sp], t[n], cfg.truncate_integer_ratio)
    return out


def _packsize_avg(k, n, types, cfg):
    r = ratio(k, n, types[k], types[n], cfg.truncate_integer_ratio)
    # an integer quotient has no decimals; a real one is rounded to 2
    if integer_rule(types[k], types[n], cfg.truncate_integer_ratio):
        return r
    return F.round(r, 2)


def _summary(frame: DataFrame, keys: list, share_by: list, cfg: LoyaltyConfig) -> DataFrame:
    n_cols, s_cols, k_cols = brand_measures(cfg)
    if is_cube(frame):
        g = roll_up(frame, keys, [*SEGMENT_SUMS, *sum(brand_measures(cfg), [])])
    else:
        g = frame.groupBy(*keys).agg(*segment_aggs(cfg))
    t = {f.name: f.dataType for f in g.schema.fields}
    over = f"OVER (PARTITION BY {', '.join(share_by)})" if share_by else "OVER ()"
    total = sum((F.col(c) for c in n_cols[1:]), F.col(n_cols[0]))
    g = g.withColumns({
        "Pct_Num_Of_Customers": pct("Num_Of_Customers", f"sum(Num_Of_Customers) {over}", 2),
        "Pct_Total_Customer_Spending": pct(
            "Total_Customer_Spending", f"sum(cast(Total_Customer_Spending as decimal(38,0))) {over}", 2),
        "Average_Purchase_Value": ratio("Total_Customer_Spending", "Num_of_Orders",
                                        t["Total_Customer_Spending"], t["Num_of_Orders"],
                                        cfg.truncate_integer_ratio),
        "Avg_Num_of_Canceled_Orders": round_div("_canceled", "Num_Of_Customers", 2),
        "Cancellation_Rate": pct("_canceled", "Num_of_Orders", 2),
        "Basket_Total_Num_Products": total,
    })
    g = g.withColumns({
        "Avg_Basket_Size": round_div("Basket_Total_Num_Products", "Num_of_Orders", 2),
        **_brand_ratios(g, cfg),
    })
    return g


def _tail(cfg: LoyaltyConfig) -> list:
    n_cols, s_cols, _ = brand_measures(cfg)
    sfx = [s for _, s in cfg.brands]
    return [
        *n_cols, *s_cols, "Basket_Total_Num_Products", "Avg_Basket_Size",
        *[f"Basket_Avg_{s}_Packsize" for s in sfx],
        *[f"Basket_Pct_{s}_Products" for s in sfx],
        *[f"Basket_Avg_Spend_On_{s}" for s in sfx],
    ]


def pivot_loyalty_tier(customers: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """A3: one row per loyalty tier; shares of all buyers and of all spend."""
    g = _summary(customers, ["Loyalty_Tier"], [], cfg)
    g = g.withColumns({
        "Avg_Num_Of_Orders": round_div("Num_of_Orders", "Num_Of_Customers", 2),
        "Avg_Customer_Lifetime_Value": whole_ratio("Total_Customer_Spending", "Num_Of_Customers",
                                                   g.schema["Total_Customer_Spending"].dataType,
                                                   g.schema["Num_Of_Customers"].dataType,
                                                   cfg.truncate_integer_ratio),
        "Avg_Retention_Time_Period": round_div("_period_min", "_period_n * 1440", 3),
    })
    return g.select(
        "Loyalty_Tier", "Num_Of_Customers", "Pct_Num_Of_Customers", "Total_Customer_Spending",
        "Pct_Total_Customer_Spending", "Average_Purchase_Value", "Avg_Num_Of_Orders",
        "Avg_Num_of_Canceled_Orders", "Cancellation_Rate", "Avg_Customer_Lifetime_Value",
        "Avg_Retention_Time_Period", *_tail(cfg),
    )


def pivot_monthly_customers_acquisition(monthly: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """A5: one row per month x acquisition type; shares within the month."""
    g = _summary(monthly, ["Order_Month", "Acquisition_Type"], ["Order_Month"], cfg)
    g = g.withColumns({
        "Retention_Time_Period": F.col("_period_min").cast("double")
        / F.nullif(F.col("_period_n") * 1440, F.lit(0)).cast("double"),
        "Buying_Frequency": round_div("Num_of_Orders", "Num_Of_Customers", 2),
    })
    return g.select(
        "Order_Month", "Acquisition_Type", "Num_Of_Customers", "Pct_Num_Of_Customers",
        "Retention_Time_Period", "Total_Customer_Spending", "Pct_Total_Customer_Spending",
        "Num_of_Orders", "Average_Purchase_Value", "Buying_Frequency", "Avg_Num_of_Canceled_Orders",
        "Cancellation_Rate", *_tail(cfg),
    )
