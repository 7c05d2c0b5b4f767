"""A7-A11, A13 — switching and funnel tables over loyal buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import month_text, pct, round_div
from loyalframe.operators.cube import CUBE_KEYS, MARK, buyers_in, entry_month, is_cube, roll_up
from loyalframe.operators.segments import segment_aggs


def _loyal(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("Loyalty_Tier") == C.TIER_LOYAL)


def _share_of_all(count_col: str):
    # denominator: sum over the few aggregated rows, not the raw data
    return pct(count_col, f"sum({count_col}) OVER ()", 2)


def switch_total_switching_status(customers: DataFrame) -> DataFrame:
    """Loyal buyers per switching status, with share."""
    g = _loyal(customers).groupBy("Switching_Status").agg(buyers_in(customers, "Num_of_Customers"))
    return g.withColumn("Pct_Num_Of_Customers", _share_of_all("Num_of_Customers"))


def switch_monthly_switching_status_loyal(customers: DataFrame) -> DataFrame:
    """Loyal buyers per first-seen month x switching status."""
    return (_loyal(customers).withColumn("Month", entry_month(customers, month_text))
            .groupBy("Month", "Switching_Status").agg(buyers_in(customers, "Num_of_Customers")))


# per-buyer measures averaged over a funnel group: output name -> (numerator, scale, denominator)
_AVERAGES = {
    "Avg_Days_To_Switch": ("cast(round(Days_To_Switch * 100) as bigint)", 2, "Days_To_Switch", 100),
    "Avg_Customer_Value": ("Total_Customer_Spending", 0, "Total_Customer_Spending", 1),
    "Avg_Purchase_Value": ("Average_Purchase_Value", 0, "Average_Purchase_Value", 1),
    "Avg_Num_Of_Orders": ("Num_of_Orders", 2, "Num_of_Orders", 1),
    "Avg_Num_of_Canceled_Orders": ("Num_of_Canceled_Orders", 2, "Num_of_Canceled_Orders", 1),
    "Avg_Retention_Time_Period": ("Retention_Minutes", 2, "Retention_Minutes", 1440),
}


GROUP_SUMS = ("_n", *[f"_{k}_{name}" for name in _AVERAGES for k in "sc"], "_orders", "_canceled")


def group_aggs() -> list:
    """The additive measures of a funnel group of buyers, ``GROUP_SUMS``."""
    aggs = [F.count("Buyer_Username").alias("_n")]
    for name, (num, _, den, _) in _AVERAGES.items():
        aggs += [F.sum(F.expr(num)).alias(f"_s_{name}"), F.count(den).alias(f"_c_{name}")]
    return [*aggs, F.sum("Num_of_Orders").alias("_orders"), F.sum("Num_of_Canceled_Orders").alias("_canceled")]


def _group_sums(df: DataFrame, keys: list) -> DataFrame:
    """Level 1: integer sums and counts per ``keys`` — a hash aggregate
    (numeric buffers only), combined map-side over the buyer rows."""
    return roll_up(df, keys, list(GROUP_SUMS)) if is_cube(df) else df.groupBy(*keys).agg(*group_aggs())


def customer_cube(customers: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """All sums that the summaries over buyers need, once per tier, funnel group, status and entry month."""
    both = group_aggs()[:-1]  # the number of cancelled orders is among the segment's sums
    return customers.withColumn("Entry_Month", month_text("First_Seen_Ts")).groupBy(*CUBE_KEYS).agg(
        F.count("Buyer_Username").alias(MARK), *segment_aggs(cfg), *both)


def _funnel_measures(g: DataFrame, keys: list, labels: list) -> DataFrame:
    """Level 2, over the few level-1 rows: the labels shown beside a group
    (their largest value, deterministic) and the exact rounded averages."""
    sums = [c for c in g.columns if c.startswith("_")]
    t = g.groupBy(*keys).agg(*[F.max(c).alias(c) for c in labels], *[F.sum(c).alias(c) for c in sums])
    out = [F.col("_n").alias("Num_Of_Customers")]
    for name, (_, scale, _, unit) in _AVERAGES.items():
        den = f"_c_{name} * {unit}" if unit != 1 else f"_c_{name}"
        out.append(round_div(f"_s_{name}", den, scale).alias(name))
    out.append(round_div("_s_Avg_Retention_Time_Period", "(_orders - _canceled) * 1440", 2)
               .alias("Avg_Days_Between_Noncanceled_Purchases"))
    return t.select(*keys, *labels, *out)


def switch_total_funnel_group(customers: DataFrame) -> DataFrame:
    """Loyal buyers per funnel group with averages.

    The status and tier shown beside each group are one value of the
    group (the largest); a pair group can hold both switchers and
    non-switchers — see :func:`switch_total_funnel_group_by_status`.
    Sums are taken per (group, status, tier) first, so the string
    ``max`` only runs on those few rows, never on the buyers.
    """
    labels = ["Switching_Status", "Loyalty_Tier"]
    g = _group_sums(_loyal(customers), ["Funnel_Group", *labels])
    return _funnel_measures(g, ["Funnel_Group"], labels)


def switch_total_funnel_group_by_status(customers: DataFrame) -> DataFrame:
    """A9 grouped by funnel group and switching status together."""
    keys = ["Funnel_Group", "Switching_Status"]
    g = _group_sums(_loyal(customers), [*keys, "Loyalty_Tier"])
    return _funnel_measures(g, keys, ["Loyalty_Tier"])


def switch_monthly_funnel_group(customers: DataFrame, switchers_only: bool = False) -> DataFrame:
    """A10 (A11 with ``switchers_only``): loyal buyers per entry month x group."""
    df = _loyal(customers)
    if switchers_only:
        df = df.where(F.col("Switching_Status") == C.STATUS_SWITCHER)
    return (df.withColumn("Month", entry_month(df, month_text))
            .groupBy("Month", "Funnel_Group").agg(buyers_in(df, "Num_of_Customers")))


def switch_monthly_funnel_group_switcher(customers: DataFrame) -> DataFrame:
    return switch_monthly_funnel_group(customers, switchers_only=True)


def loyal_status_share(customers: DataFrame) -> DataFrame:
    """Loyal buyers per tier x status, group size, total and share."""
    g = _loyal(customers).groupBy("Loyalty_Tier", "Switching_Status").agg(
        buyers_in(customers, "Group_Size"))
    return g.withColumns({
        "Total_Customers": F.expr("sum(Group_Size) OVER ()"),
        "Percentage_of_Total": pct("Group_Size", "sum(Group_Size) OVER ()", 2),
    })
