"""F22, F23 — histograms of returning buyers' first-seen time.

Equal-width bins over a range, numpy's rule: ``n`` bins between min and
max, the last bin closed; a zero-width range is widened to +-0.5 day.
Binning is integer arithmetic on minutes, so a value on a bin edge lands
in the upper bin exactly. Only non-empty bins are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalframe.functions import idiv, minute_text
from loyalframe.operators.monthly import returning_customers

HALF_DAY_MIN = 720


def _returning_minutes(monthly: DataFrame) -> DataFrame:
    r = returning_customers(monthly).where(
        F.col("Lifetime_First_Seen_Ts").isNotNull() & F.col("Order_Month").isNotNull())
    return r.select("Order_Month", idiv(F.unix_timestamp("Lifetime_First_Seen_Ts"), F.lit(60)).alias("_x"))


def _counted(monthly: DataFrame) -> DataFrame:
    """Returning buyers per (order month, first-seen minute), combined
    map-side: every histogram and range below reads this one aggregate,
    so its exchange is shared (and a month holding many rows shrinks
    before any shuffle)."""
    return _returning_minutes(monthly).groupBy("Order_Month", "_x").agg(F.count(F.lit(1)).alias("_n"))


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> tuple[Column, Column, Column]:
    flat = lo == hi
    lo2 = F.when(flat, lo - HALF_DAY_MIN).otherwise(lo)
    hi2 = F.when(flat, hi + HALF_DAY_MIN).otherwise(hi)
    b = F.least(idiv((x - lo2) * bins, hi2 - lo2), F.lit(bins - 1))
    return b, lo2, hi2


def _range_text(m: Column) -> Column:
    return minute_text(F.timestamp_seconds(m * 60))


def first_seen_hist(monthly: DataFrame, bins: int = 60) -> DataFrame:
    """counts per order month and bin, bins over the global range.

    The global min / max are a scalar subquery over the same counted
    rows as the bins: Spark computes it first and uses it as a constant
    (nothing gathered to the driver). Adaptive execution shares its
    stage cache with subqueries, so the subquery reads the month x buyer
    shuffle the bins use instead of deriving the rows a second time.
    """
    c = _counted(monthly)
    rng = c.select(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    # the subquery appears once in the plan; the bin expression reads its columns
    c = c.withColumn("_rng", rng).select("Order_Month", "_x", "_n", F.col("_rng.lo").alias("_lo"),
                                         F.col("_rng.hi").alias("_hi"))
    b, lo2, hi2 = _bin(F.col("_x"), F.col("_lo"), F.col("_hi"), bins)
    return c.groupBy("Order_Month", b.alias("Bin"), _range_text(lo2).alias("Range_Start"),
                     _range_text(hi2).alias("Range_End")).agg(F.sum("_n").alias("Num_Customers"))


def first_seen_hist_by_month(monthly: DataFrame, bins: int = 15) -> DataFrame:
    """per order month, bins over that month's own min-max range.

    Buyers are first counted per (month, first-seen minute) with map-side
    combine, so a month holding a large share of rows shrinks before any
    exchange. The per-month range (one row per calendar month: its size
    is bounded by the calendar, not by the data) is broadcast to the
    counted rows; no exchange is keyed on the month alone.
    """
    counted = _counted(monthly)
    rng = counted.groupBy("Order_Month").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    j = counted.join(F.broadcast(rng), "Order_Month")
    b, lo2, hi2 = _bin(F.col("_x"), F.col("_lo"), F.col("_hi"), bins)
    return j.groupBy("Order_Month", b.alias("Bin"), _range_text(lo2).alias("Range_Start"),
                     _range_text(hi2).alias("Range_End")).agg(F.sum("_n").alias("Num_Customers"))
