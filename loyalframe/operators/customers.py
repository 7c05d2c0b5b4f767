"""A2 — one row per buyer (``total_customers_data``) and its rules P5-P8.

Tier, funnel group, switching status / time / days are ``when`` chains
on the per-buyer aggregate (the tier's branch order is the rule); the
funnel rules are stated on two small bitmasks, see ``with_brand_sets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import days_from_minutes, minute_text, minutes_between, pct, ratio, round_div
from loyalframe.operators.orders import brand_measures


def ft_col(brand: str) -> str:
    return f"First_Time_Purchase_{brand}"


def customers_frame(orders: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG,
                    extra_aggs: dict | None = None) -> DataFrame:
    """Per-buyer aggregate of the order frame plus tier / funnel / switching.

    Every aggregate is algebraic (count/sum/min/max), so the shuffle on
    the buyer carries partial aggregates only: the pseudo buyer of all
    buyer-less orders, a hot key, is combined map-side.
    Internal columns: ``*_Ts`` timestamps, ``Retention_Minutes``.
    ``extra_aggs`` (name -> aggregate over orders) adds per-buyer columns
    computed in the same pass, e.g. a flag a question filters on.
    """
    n_cols, s_cols, k_cols = brand_measures(cfg)
    ts = F.col("Order_Ts")
    aggs = [
        F.count("Order_ID").alias("Num_of_Orders"),
        F.count(F.when(F.col("Order_Status") == cfg.cancelled_status, 1)).alias("Num_of_Canceled_Orders"),
        F.min(ts).alias("First_Seen_Ts"),
        F.max(ts).alias("Last_Seen_Ts"),
        F.sum("Order_Amount").alias("Total_Customer_Spending"),
        F.sum("Sum_SKU_Subtotal_After_Discount").alias("Merchandise_Value"),
    ]
    aggs += [F.sum(c).alias(c) for c in n_cols + s_cols + k_cols]
    for b in cfg.funnel_brands:
        n = f"Basket_Num_{cfg.brand_suffix(b)}_Products"
        aggs.append(F.min(F.when(F.col(n) > 0, ts)).alias(ft_col(b) + "_Ts"))
    aggs += [a.alias(n) for n, a in (extra_aggs or {}).items()]
    g = orders.groupBy("Buyer_Username").agg(*aggs)
    types = {f.name: f.dataType for f in g.schema.fields}
    total = sum((F.col(c) for c in n_cols[1:]), F.col(n_cols[0]))
    g = g.withColumns({
        "Retention_Minutes": minutes_between("Last_Seen_Ts", "First_Seen_Ts"),
        "Average_Purchase_Value": ratio("Total_Customer_Spending", "Num_of_Orders",
                                        types["Total_Customer_Spending"], types["Num_of_Orders"],
                                        cfg.truncate_integer_ratio),
        "Basket_Total_Num_Products": total,
    })
    g = g.withColumns({
        "Retention_Time_Period": days_from_minutes("Retention_Minutes"),
        "Avg_Basket_Size": round_div("Basket_Total_Num_Products", "Num_of_Orders", 2),
        **{f"Basket_Pct_{s}_Products": pct(n, "Basket_Total_Num_Products", 2)
           for (_, s), n in zip(cfg.brands, n_cols)},
    })
    g = with_brand_sets(g.withColumn("Loyalty_Tier", loyalty_tier(cfg)), cfg)
    g = g.withColumns({"Funnel_Group": funnel_group(cfg), "Switching_Status": switching_status(cfg)})
    g = g.withColumn("Switching_Ts", F.when(F.col("Switching_Status") == C.STATUS_SWITCHER,
                                            switching_time(cfg)))
    sw_min = "(unix_timestamp(Switching_Ts) - unix_timestamp(First_Seen_Ts)) div 60"
    return g.withColumn("Days_To_Switch", round_div(sw_min, "1440", 2))


def loyalty_tier(cfg: LoyaltyConfig = DEFAULT_CONFIG) -> Column:
    """Tier rule; the first matching branch wins."""
    n, x = F.col("Num_of_Orders"), F.col("Num_of_Canceled_Orders")
    return (
        F.when((n >= 1) & (F.col("Total_Customer_Spending") == 0), C.TIER_AFFILIATOR)
        .when(n - x == 0, C.TIER_CANCELED)
        .when((F.col("Retention_Time_Period") < cfg.confused_max_days) & (n >= 2) & (n - x >= 1) & (x != 0),
              C.TIER_CONFUSED)
        .when(n >= 2, C.TIER_LOYAL)
        .when(n == 1, C.TIER_ONE_TIME)
        .otherwise(C.UNSORTED)
    )


def _ft(b: str) -> Column:
    return F.col(ft_col(b) + "_Ts")


def _bit(i: int) -> int:
    return 1 << i


def with_brand_sets(g: DataFrame, cfg: LoyaltyConfig) -> DataFrame:
    """Two small bitmasks the funnel rules are stated on (bit i = funnel brand i).

    ``_seen``  : brands ever bought.
    ``_entry`` : the entry set — the brands of the first purchase, where
                 a tie is resolved as the shop's rule does: the first
                 pair in priority order that ties wins, so a three-way tie
                 counts as the first pair unless ``three_way_ties_first``.
    Stating the rules on these keeps each derived column a small
    expression, so filters that Catalyst pushes through them stay small.
    """
    fts = [_ft(b) for b in cfg.funnel_brands]
    first = F.least(*fts)
    seen = sum((F.when(f.isNotNull(), _bit(i)).otherwise(0) for i, f in enumerate(fts)), F.lit(0))
    at_first = sum((F.when(f == first, _bit(i)).otherwise(0) for i, f in enumerate(fts)), F.lit(0))
    g = g.withColumns({"_seen": seen, "_at_first": at_first})
    a = F.col("_at_first")
    pairs = [_bit(0) | _bit(1), _bit(0) | _bit(2), _bit(1) | _bit(2)]
    entry = F.when(a == 0, 0)
    if cfg.three_way_ties_first:
        entry = entry.when(a == 7, 7)
    for m in pairs:
        entry = entry.when(a.bitwiseAND(m) == m, m)
    return g.withColumn("_entry", entry.otherwise(a)).drop("_at_first")


def funnel_group(cfg: LoyaltyConfig = DEFAULT_CONFIG) -> Column:
    """Entry group: no brand; only one brand; a pair bought first together;
    all three; the single earliest brand (needs ``_seen`` / ``_entry``)."""
    names = cfg.funnel_brands
    e, seen = F.col("_entry"), F.col("_seen")
    expr = F.when(e == 0, C.GROUP_NONE).when(e == 7, C.GROUP_ALL_THREE)
    for i, x in enumerate(names):
        expr = expr.when((e == _bit(i)) & (seen == _bit(i)), C.ONLY_WITH.format(x))
        expr = expr.when(e == _bit(i), C.START_WITH.format(x))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        expr = expr.when(e == (_bit(i) | _bit(j)), C.START_WITH_PAIR.format(names[i], names[j]))
    return expr.otherwise(C.UNSORTED)


def switching_status(cfg: LoyaltyConfig = DEFAULT_CONFIG) -> Column:
    """P5: a buyer who later bought a funnel brand outside the entry set is a
    switcher; one whose purchases stay inside it is not."""
    e, seen = F.col("_entry"), F.col("_seen")
    return (
        F.when(e == 0, C.GROUP_NONE)
        .when(e == 7, C.GROUP_ALL_THREE)
        .when(seen != e, C.STATUS_SWITCHER)
        .otherwise(C.STATUS_NON_SWITCHER)
    )


def switching_time(cfg: LoyaltyConfig = DEFAULT_CONFIG) -> Column:
    """First purchase of a funnel brand outside the entry set."""
    e = F.col("_entry")
    outside = [F.when(e.bitwiseAND(_bit(i)) == 0, _ft(b)) for i, b in enumerate(cfg.funnel_brands)]
    return F.least(*outside)


def customer_columns(cfg: LoyaltyConfig = DEFAULT_CONFIG) -> list:
    """Published column list of ``total_customers_data``, in order."""
    n_cols, s_cols, k_cols = brand_measures(cfg)
    return [
        "Buyer_Username", "Num_of_Orders", "Num_of_Canceled_Orders",
        minute_text("First_Seen_Ts").alias("First_Seen"), minute_text("Last_Seen_Ts").alias("Last_Seen"),
        "Retention_Time_Period", "Total_Customer_Spending", "Merchandise_Value", "Average_Purchase_Value",
        *n_cols, "Basket_Total_Num_Products", "Avg_Basket_Size", *s_cols, *k_cols,
        *[minute_text(ft_col(b) + "_Ts").alias(ft_col(b)) for b in cfg.funnel_brands],
        *[f"Basket_Pct_{s}_Products" for _, s in cfg.brands],
        "Loyalty_Tier", "Funnel_Group", "Switching_Status",
        minute_text("Switching_Ts").alias("Switching_Time"), "Days_To_Switch",
    ]


def total_customers_data(customers: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    return customers.select(*customer_columns(cfg))


def filter_loyal_switching_customers(customers: DataFrame) -> DataFrame:
    """Loyal switchers, 9 columns (order by spend at read time)."""
    return customers.where(
        (F.col("Switching_Status") == C.STATUS_SWITCHER) & (F.col("Loyalty_Tier") == C.TIER_LOYAL)
    ).select(
        "Buyer_Username", "Loyalty_Tier", "Funnel_Group", minute_text("First_Seen_Ts").alias("First_Seen"),
        minute_text("Switching_Ts").alias("Switching_Time"), "Days_To_Switch", "Total_Customer_Spending",
        "Num_of_Orders", "Num_of_Canceled_Orders",
    )
