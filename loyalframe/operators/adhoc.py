"""D4, D5, W4, A14, P14 — the shop's ad-hoc questions as parameterised frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import minute_text, month_text
from loyalframe.operators.cube import buyers_in, entry_month
from loyalframe.operators.customers import (
    customer_columns, customers_frame, ft_col, switching_status, switching_time, with_brand_sets,
)
from loyalframe.sources.sinks import MONTH, in_months


def customers_active_between(orders: DataFrame, start: str, end: str,
                             cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """Buyers with an order in ``[start, end)``, with their whole-history
    customer columns.

    Half-open on real timestamps, so an order at midnight of ``start`` is
    in and one at midnight of ``end`` is out. The shop asked this as an
    EXISTS sub-select; here "has an order in the window" is one more
    per-buyer aggregate of the same pass that builds the customer rows,
    then a filter — no second read of the orders and no semi-join, so the
    pseudo buyer of buyer-less orders (a hot key) is combined map-side
    like every other buyer. Of orders stored by month and bucketed by buyer
    the buyers are found in the window's months only, and the semi-join that
    takes their whole history has no exchange.
    """
    ts = F.col("Order_Ts")
    hit = (ts >= F.to_timestamp(F.lit(start))) & (ts < F.to_timestamp(F.lit(end)))
    if MONTH in orders.columns:
        ids = in_months(orders, start[:7], end[:7]).where(hit).select(F.col("Buyer_Username").alias("_active")).distinct()
        some = orders.join(ids, F.col("Buyer_Username") == F.col("_active"), "left_semi")
        return customers_frame(some, cfg).select(*customer_columns(cfg))
    c = customers_frame(orders, cfg, {"_active": F.max(F.when(hit, F.lit(1)))})
    return c.where(F.col("_active") == 1).select(*customer_columns(cfg))


def monthly_funnel(orders: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """Buyers, returning buyers and first switches per month.

    Months are those with orders; a month without switches counts 0. One
    pass over the orders, no join: orders are aggregated per month x buyer
    with each funnel brand's first purchase in the month; a buyer window
    over those rows (at most one per month per buyer) gives the lifetime
    first order and first purchases, from which the customer switching
    rules give each buyer's switch time. Every month x buyer row then
    counts once for its month (and as returning when the buyer was seen in
    an earlier month); each buyer's first-month row also counts once for
    the month of the switch. One aggregate by month adds them up.
    """
    ts = F.col("Order_Ts")
    fts = {b: ft_col(b) + "_Ts" for b in cfg.funnel_brands}
    firsts = [F.min(F.when(F.col(f"Basket_Num_{cfg.brand_suffix(b)}_Products") > 0, ts)).alias(c)
              for b, c in fts.items()]
    per = orders.groupBy(month_text(ts).alias("Month"), "Buyer_Username").agg(
        F.min(ts).alias("_first_in_month"), *firsts)
    w = Window.partitionBy("Buyer_Username")
    per = per.withColumns({"_life_first": F.min("_first_in_month").over(w),
                           **{c: F.min(c).over(w) for c in fts.values()}})
    per = with_brand_sets(per, cfg).withColumn("_status", switching_status(cfg))
    switch_month = F.when((F.col("_status") == C.STATUS_SWITCHER)
                          & (F.col("Month") == month_text("_life_first")), month_text(switching_time(cfg)))
    returning = F.when(month_text("_life_first") < F.col("Month"), 1).otherwise(0)
    events = per.select(F.explode(F.array(
        F.struct(F.col("Month").alias("m"), F.lit(1).alias("tot"), returning.alias("ret"), F.lit(0).alias("sw")),
        F.struct(switch_month.alias("m"), F.lit(0).alias("tot"), F.lit(0).alias("ret"), F.lit(1).alias("sw")),
    )).alias("e")).where((F.col("e.tot") == 1) | F.col("e.m").isNotNull())  # orders without a time keep their NULL month
    g = events.groupBy(F.col("e.m").alias("Month")).agg(
        F.sum("e.tot").alias("Total_Count"), F.sum("e.ret").alias("Returning_Count"),
        F.sum("e.sw").alias("Switching_Count"))
    # a switch happens at an order, so its month always has buyers
    return g.where(F.col("Total_Count") > 0)


def second_purchase(orders: DataFrame) -> DataFrame:
    """Each buyer's second order time (ties broken by order id).

    ``row_number() == 2`` lets Spark add a WindowGroupLimit before the
    shuffle, so even the pseudo buyer of all buyer-less orders ships
    at most two rows per input partition.
    """
    w = Window.partitionBy("Buyer_Username").orderBy("Order_Ts", "Order_ID")
    return (orders.select("Buyer_Username", "Order_Ts", "Order_ID")
            .withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") == 2)
            .select("Buyer_Username", minute_text("Order_Ts").alias("second_purchase_date")))


def entry_month_by_tier(customers: DataFrame) -> DataFrame:
    """Buyers per first-seen month x loyalty tier."""
    return (customers.groupBy(entry_month(customers, month_text).alias("Entry_Month"), "Loyalty_Tier")
            .agg(buyers_in(customers, "Num_Of_Customers")))


def subcategory_month_lines(lines: DataFrame, sub_category: str, month: str) -> DataFrame:
    """The lines of one sub-category in one month (of lines stored by month, only that partition is read)."""
    return (in_months(lines, month, month).withColumn("Month_Year", month_text("Created_At"))
            .where((F.col("Sub_category") == sub_category) & (F.col("Month_Year") == month)))
