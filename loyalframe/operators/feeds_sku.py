"""Per-SKU time series feeds.

Buckets follow pandas: ``W-MON`` / ``W`` (= ``W-SUN``) weekly bins are
labelled by their closing day, the day itself included; ``D`` is the
calendar day. A SKU list (``(name, variant)`` pairs) is a parameter; it
is turned into a tiny DataFrame and semi-joined, so its size is the
list's length. Pivots list their values explicitly (no extra job to
discover them).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.functions import week_ending
from loyalframe.sources.sinks import in_months

Sku = tuple[str, str]


def _skus_df(lines: DataFrame, skus: list[Sku]) -> DataFrame:
    return lines.sparkSession.createDataFrame(list(skus), "Product_SKU_Name string, Product_Variant string")


def lines_for_skus(lines: DataFrame, skus: list[Sku]) -> DataFrame:
    """Lines whose (name, variant) is one of ``skus``."""
    return lines.join(F.broadcast(_skus_df(lines, skus)), ["Product_SKU_Name", "Product_Variant"], "left_semi")


def _names(skus: list[Sku]) -> list[str]:
    return list(dict.fromkeys(n for n, _ in skus))


def in_scope(lines: DataFrame, scope_end: str | None) -> DataFrame:
    """P10: lines with a parsed time, up to the report end (inclusive)."""
    ts = F.col("Created_At")
    cond = ts.isNotNull()
    if scope_end is not None:
        cond = cond & (ts <= F.to_timestamp(F.lit(scope_end)))
    return in_months(lines, None, scope_end and scope_end[:7]).where(cond)


def priced_lines(lines: DataFrame) -> DataFrame:
    """Lines with a positive unit price (drops samples and gifts priced 0)."""
    return lines.where(F.col("SKU_Unit_Original_Price") > 0)


def _per_unit(total: Column) -> Column:
    q = F.col("Quantity")
    return F.when(q != 0, total.cast("double") / q.cast("double"))


def after_seller_price() -> Column:
    """(unit price x quantity - seller discount) / quantity; NULL for 0 units."""
    return _per_unit(F.col("SKU_Unit_Original_Price") * F.col("Quantity") - F.col("SKU_Seller_Discount"))


def sku_weekly_price(lines: DataFrame, scope_end: str | None = None, skus: list[Sku] | None = None) -> DataFrame:
    """weekly (W-MON) mean unit price, price after seller discount and
    order amount per unit, lines with a positive unit price; weeks between
    a SKU's first and last week that have no line appear with NULLs.

    Without ``skus`` every SKU is covered. The gap weeks come from a
    ``lead`` over each SKU's weekly rows: the window runs on the weekly
    aggregate (one row per SKU and week with sales, bounded by the
    calendar even for a SKU holding most of the lines), and each week
    expands to itself plus the empty weeks before the SKU's next one, in
    one pass (no join, no second branch over the lines).
    """
    d = priced_lines(in_scope(lines, scope_end))
    if skus is not None:
        d = lines_for_skus(d, skus)
    else:  # every labelled SKU
        d = d.where(F.col("Product_SKU_Name").isNotNull() & F.col("Product_Variant").isNotNull())
    keys = ["Product_SKU_Name", "Product_Variant"]
    measures = ["Avg_Original_Price", "Avg_After_Seller_Discount", "Avg_Customer_Paid"]
    w = d.withColumn("Week", week_ending("Created_At", "MON")).groupBy(*keys, "Week").agg(
        F.avg("SKU_Unit_Original_Price").alias(measures[0]),
        F.avg(after_seller_price()).alias(measures[1]),
        F.avg(_per_unit(F.col("Order_Amount"))).alias(measures[2]),
    )
    w = w.withColumn("_next", F.lead("Week").over(Window.partitionBy(*keys).orderBy("Week")))
    last = F.coalesce(F.date_sub("_next", 7), F.col("Week"))  # the week itself when no gap follows
    weeks = F.sequence(F.col("Week"), last, F.expr("INTERVAL 7 DAYS"))
    x = w.select(*keys, *measures, F.posexplode(weeks).alias("_i", "_week"))
    return x.select(*keys, F.col("_week").alias("Week"),
                    *[F.when(F.col("_i") == 0, F.col(m)).alias(m) for m in measures])


def sku_weekly_units(lines: DataFrame, skus: list[Sku], scope_end: str | None = None) -> DataFrame:
    """W-MON units per SKU (one column per SKU name, 0-filled); weeks
    without any unit dropped."""
    names = _names(skus)
    d = lines_for_skus(in_scope(lines, scope_end), skus)
    p = d.groupBy(week_ending("Created_At", "MON").alias("Week")).pivot("Product_SKU_Name", names).agg(
        F.sum("Quantity")).na.fill(0, subset=names)
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    return p.where(total > 0)


def sunday_edges(start: str, end: str) -> list[dt.date]:
    """Sundays in ``[start, end]`` (pandas ``date_range(freq='W')``)."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    first = a + dt.timedelta(days=(6 - a.weekday()) % 7)
    return [first + dt.timedelta(days=7 * i) for i in range((b - first).days // 7 + 1)] if first <= b else []


def sku_weekly_line_counts(lines: DataFrame, skus: list[Sku], start: str, end: str) -> DataFrame:
    """lines per SKU in fixed Sunday-midnight weekly bins between
    ``start`` and ``end`` (left-closed, last bin closed, outside dropped);
    non-empty bins only."""
    edges = sunday_edges(start, end)
    lines = in_months(lines, edges[0].isoformat()[:7], edges[-1].isoformat()[:7])
    d = lines_for_skus(lines.where(F.col("Created_At").isNotNull()), skus)
    first = F.to_timestamp(F.lit(edges[0].isoformat()))
    last = F.to_timestamp(F.lit(edges[-1].isoformat()))
    ts = F.col("Created_At")
    k = len(edges) - 1
    secs = F.unix_timestamp(ts) - F.unix_timestamp(first)
    b = F.least(F.call_function("div", secs, F.lit(7 * 86400)), F.lit(k - 1))
    d = d.where((ts >= first) & (ts <= last))
    return d.groupBy("Product_SKU_Name", "Product_Variant", b.alias("Bin")).agg(
        F.count(F.lit(1)).alias("Num_Lines")).withColumn(
        "Bin_Start", F.date_add(F.to_date(first), (F.col("Bin") * 7).cast("int")))


def _bucket(freq: str) -> Column:
    if freq == "D":
        return F.to_date("Created_At")
    return week_ending("Created_At", "SUN")


def sku_quantity(lines: DataFrame, skus: list[Sku], freq: str = "W") -> DataFrame:
    """units per bucket (W-SUN week or day) and SKU name, 0-filled;
    only buckets with a line of some SKU appear."""
    names = _names(skus)
    d = lines_for_skus(lines.where(F.col("Created_At").isNotNull()), skus)
    return d.groupBy(_bucket(freq).alias("Period")).pivot("Product_SKU_Name", names).agg(
        F.sum("Quantity")).na.fill(0, subset=names)


METRICS = {
    "subtotal": lambda: F.col("SKU_Subtotal_After_Discount"),
    "original_price": lambda: F.col("SKU_Unit_Original_Price"),
    # clipped at 0 from below; a missing value stays missing
    "after_seller": lambda: F.when(after_seller_price().isNotNull(), F.greatest(after_seller_price(), F.lit(0.0))),
}


def sku_weekly_mean(lines: DataFrame, skus: list[Sku], metric: str = "subtotal") -> DataFrame:
    """W-SUN mean of a per-line metric per SKU name (NULL where absent)."""
    names = _names(skus)
    d = lines_for_skus(lines.where(F.col("Created_At").isNotNull()), skus)
    return d.groupBy(_bucket("W").alias("Week")).pivot("Product_SKU_Name", names).agg(F.avg(METRICS[metric]()))


def sku_daily_price_range(lines: DataFrame, skus: list[Sku]) -> DataFrame:
    """daily min / max / mean after-discount subtotal per SKU name."""
    d = lines_for_skus(lines.where(F.col("Created_At").isNotNull()), skus)
    v = F.col("SKU_Subtotal_After_Discount")
    return d.groupBy(F.to_date("Created_At").alias("Day"), "Product_SKU_Name").agg(
        F.min(v).alias("Min_Subtotal"), F.max(v).alias("Max_Subtotal"), F.avg(v).alias("Mean_Subtotal"),
    ).where(F.col("Mean_Subtotal").isNotNull())
