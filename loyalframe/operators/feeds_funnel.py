"""Chart feeds over the funnel tables.

Inputs are ``switch_total_funnel_group`` (one row per funnel group) and
``switch_monthly_funnel_group`` (month x group), both small results; the
windows without partition below run on those few rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig


def _n() -> Column:
    return F.coalesce(F.col("Num_Of_Customers"), F.lit(0))


def _ltv() -> Column:
    return F.coalesce(F.col("Avg_Customer_Value"), F.lit(0.0))


def _fdiv(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def funnel_ltv_rank(fg: DataFrame) -> DataFrame:
    """groups by average customer value (rank 1 = lowest), with n x value."""
    return fg.select(
        "Funnel_Group", _n().alias("Num_Of_Customers"), _ltv().alias("Avg_Customer_Value"),
        (_n() * _ltv()).alias("Total_Value"),
        F.row_number().over(Window.orderBy(_ltv(), F.col("Funnel_Group"))).alias("Ltv_Rank"),
    )


def switcher_weight(fg: DataFrame) -> DataFrame:
    """switchers' share of loyal heads and of value (n x average value)."""
    sw = F.lower(F.coalesce(F.col("Switching_Status"), F.lit(""))) == "switcher"
    v = _n() * _ltv()
    g = fg.agg(
        F.sum(F.when(sw, _n()).otherwise(0)).alias("Switcher_Customers"),
        F.sum(F.when(~sw, _n()).otherwise(0)).alias("Other_Customers"),
        F.sum(F.when(sw, v).otherwise(0.0)).alias("Switcher_Value"),
        F.sum(F.when(~sw, v).otherwise(0.0)).alias("Other_Value"),
    )
    n_tot = F.col("Switcher_Customers") + F.col("Other_Customers")
    v_tot = F.col("Switcher_Value") + F.col("Other_Value")
    return g.select(
        "*",
        (_fdiv(F.col("Switcher_Customers"), n_tot) * 100.0).alias("Switcher_Pct_Customers"),
        (_fdiv(F.col("Switcher_Value"), v_tot) * 100.0).alias("Switcher_Pct_Value"),
        _fdiv(_fdiv(F.col("Switcher_Value"), F.col("Switcher_Customers")),
              _fdiv(F.col("Other_Value"), F.col("Other_Customers"))).alias("Value_Per_Head_Ratio"),
    )


def cross_buy_rate(fg: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """F16: per entry brand, % of its loyal entrants who also bought another brand."""
    g = F.col("Funnel_Group")
    per_brand = fg.agg(*[
        F.struct(
            F.lit(b).alias("Brand"),
            F.coalesce(F.sum(F.when(g == C.ONLY_WITH.format(b), _n())), F.lit(0)).alias("Only_Customers"),
            F.coalesce(F.sum(F.when(g == C.START_WITH.format(b), _n())), F.lit(0)).alias("Start_Customers"),
        ).alias(f"_b{i}") for i, b in enumerate(cfg.funnel_brands)
    ])
    rows = per_brand.select(F.inline(F.array(*[F.col(f"_b{i}") for i in range(len(cfg.funnel_brands))])))
    tot = F.col("Only_Customers") + F.col("Start_Customers")
    return rows.withColumn(
        "Cross_Buy_Rate", F.when(tot != 0, _fdiv(F.col("Start_Customers"), tot) * 100.0).otherwise(0.0))


def days_to_switch_rank(fg: DataFrame) -> DataFrame:
    """groups with a days-to-switch value, fastest first."""
    d = F.col("Avg_Days_To_Switch")
    return fg.where(d.isNotNull()).select(
        "Funnel_Group", "Avg_Days_To_Switch",
        F.row_number().over(Window.orderBy(d, F.col("Funnel_Group"))).alias("Switch_Rank"))


def funnel_cancel_rate(fg: DataFrame) -> DataFrame:
    """average cancelled / average orders x 100 per group (0 without orders)."""
    orders = F.coalesce(F.col("Avg_Num_Of_Orders"), F.lit(0.0))
    cancel = F.coalesce(F.col("Avg_Num_of_Canceled_Orders"), F.lit(0.0))
    rate = F.when(orders != 0, (cancel / orders) * 100.0).otherwise(0.0)
    return fg.select("Funnel_Group", rate.alias("Cancel_Rate")).withColumn(
        "Cancel_Rank", F.row_number().over(Window.orderBy(F.col("Cancel_Rate"), F.col("Funnel_Group"))))


def value_map(fg: DataFrame) -> DataFrame:
    """value vs orders per group and the head-weighted mean value."""
    w = Window.partitionBy()
    return fg.select(
        "Funnel_Group", _n().alias("Num_Of_Customers"), _ltv().alias("Avg_Customer_Value"),
        F.coalesce(F.col("Avg_Num_Of_Orders"), F.lit(0.0)).alias("Avg_Num_Of_Orders"),
        _fdiv(F.sum(_n() * _ltv()).over(w), F.sum(_n()).over(w)).alias("Weighted_Avg_Customer_Value"),
    )


def monthly_funnel_stack(mfg: DataFrame, groups=C.STACK_ORDER) -> DataFrame:
    """loyal buyers per entry month and stack group (0-filled) + month total.

    Groups outside the stack list are summed as ``Other``, so that the total
    is every loyal buyer of the month.
    """
    shown = F.when(F.col("Funnel_Group").isin(*groups), F.col("Funnel_Group")).otherwise("Other")
    names = [*groups, "Other"]
    p = mfg.withColumn("Funnel_Group", shown).groupBy("Month").pivot("Funnel_Group", names).agg(
        F.sum("Num_of_Customers")).na.fill(0, subset=names)
    total = sum((F.col(f"`{g}`") for g in names[1:]), F.col(f"`{names[0]}`"))
    return p.withColumn("Total", total)


def switcher_share_by_month(mfg: DataFrame, groups=C.STACK_ORDER, censored_months: int = 2) -> DataFrame:
    """% of each entry-month cohort (all its groups) in a "Start ..." group, cohort size,
    and a flag on the youngest ``censored_months`` cohorts (too young to
    have switched yet)."""
    g = F.col("Funnel_Group")
    n = F.col("Num_of_Customers")
    starts = [x for x in groups if x.startswith("Start")]
    m = mfg.groupBy("Month").agg(
        F.sum(n).alias("Cohort_Size"), F.sum(F.when(g.isin(*starts), n).otherwise(0)).alias("_sw"))
    share = F.when(F.col("Cohort_Size") != 0, _fdiv(F.col("_sw"), F.col("Cohort_Size")) * 100.0).otherwise(0.0)
    young = F.dense_rank().over(Window.orderBy(F.col("Month").desc())) <= censored_months
    return m.select("Month", "Cohort_Size", share.alias("Switcher_Share"), young.alias("Censored"))
