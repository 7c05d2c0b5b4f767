"""W5, W6 — retention against the pool of earlier new customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.functions import pct


def _month_counts(monthly: DataFrame) -> DataFrame:
    """New / returning buyers per month (= the two A5 customer counts)."""
    t = F.col("Acquisition_Type")
    return monthly.groupBy("Order_Month").agg(
        F.count(F.when(t == C.ACQ_NEW, 1)).alias("New_Customers"),
        F.count(F.when(t == C.ACQ_RETURNING, 1)).alias("Returning_Customers"),
    )


def monthly_retention_rate(monthly: DataFrame) -> DataFrame:
    """Per month, new buyers, the pool of all earlier new buyers, returning
    buyers and returning / pool in percent (2 dp, half to even; NULL on an
    empty pool).

    The running total is a window without partition: it runs on the
    per-month rows (one per calendar month), never on buyer rows.
    """
    m = _month_counts(monthly)
    before = Window.orderBy("Order_Month").rowsBetween(Window.unboundedPreceding, -1)
    pool = F.coalesce(F.sum("New_Customers").over(before), F.lit(0))
    m = m.withColumn("Legacy_Pool", pool)
    return m.select(
        "Order_Month", "New_Customers", "Legacy_Pool", "Returning_Customers",
        F.when(F.col("Legacy_Pool") > 0, pct("Returning_Customers", "Legacy_Pool", 2, half_even=True))
        .alias("Retention_Rate_Pct"),
    )


def pool_vs_retention(monthly: DataFrame) -> DataFrame:
    """The chart variant — the running total is undefined in a month with
    no new buyers, so the next month's pool is missing; months without a
    pool or without returning buyers are left out; the rate is unrounded.
    """
    m = _month_counts(monthly)
    new = F.when(F.col("New_Customers") > 0, F.col("New_Customers"))
    ret = F.when(F.col("Returning_Customers") > 0, F.col("Returning_Customers"))
    upto = Window.orderBy("Order_Month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("_cum", F.when(new.isNotNull(), F.sum(new).over(upto)))
    m = m.withColumn("Legacy_Pool", F.lag("_cum", 1).over(Window.orderBy("Order_Month")))
    rate = (ret.cast("double") / F.col("Legacy_Pool").cast("double")) * F.lit(100.0)
    return m.select("Order_Month", "Legacy_Pool", rate.alias("Retention_Rate")).where(
        F.col("Retention_Rate").isNotNull())
