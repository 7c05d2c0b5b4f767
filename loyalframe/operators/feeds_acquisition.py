"""Chart feeds over the monthly acquisition summary.

Every feed here starts from ``pivot_monthly_customers_acquisition`` — at
most two rows per month — so they are tiny aggregations; "pivot by
customer kind" is a conditional aggregate per month (one row per month x
type, so ``max`` picks the row's value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalframe import config as C
from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import customer_kind, phase_of_month


def _kind() -> Column:
    return customer_kind("Acquisition_Type")


def _of(kind: str, c: str) -> Column:
    return F.max(F.when(_kind() == kind, F.col(c)))


def _fdiv(a, b) -> Column:
    """Real division, NULL (not an error) on a zero or missing divisor."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def active_months(acq: DataFrame) -> DataFrame:
    """Months whose total spend is > 0 (months with sales), with that spend."""
    g = acq.groupBy("Order_Month").agg(F.sum("Total_Customer_Spending").alias("Total_Customer_Spending"))
    return g.where(F.col("Total_Customer_Spending") > 0)


def revenue_orders_by_month(acq: DataFrame) -> DataFrame:
    """spend of new / returning buyers and all orders, active months."""
    g = acq.groupBy("Order_Month").agg(
        F.coalesce(F.sum(F.when(_kind() == "new", F.col("Total_Customer_Spending"))), F.lit(0)).alias("New_Spending"),
        F.coalesce(F.sum(F.when(_kind() == "ret", F.col("Total_Customer_Spending"))), F.lit(0))
        .alias("Returning_Spending"),
        F.sum("Num_of_Orders").alias("Num_of_Orders"),
        F.sum("Total_Customer_Spending").alias("_spend"),
    )
    return g.where(F.col("_spend") > 0).drop("_spend")


def brand_share_by_month(acq: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """each brand's % of units and % of spend per active month (0 if none)."""
    sfx = [s for _, s in cfg.brands]
    g = acq.groupBy("Order_Month").agg(
        *[F.coalesce(F.sum(f"Basket_Num_{s}_Products"), F.lit(0)).alias(f"_u_{s}") for s in sfx],
        *[F.coalesce(F.sum(f"Basket_{s}_Spend_Amnt"), F.lit(0)).alias(f"_s_{s}") for s in sfx],
        F.sum("Total_Customer_Spending").alias("_spend"),
    )
    tu = sum((F.col(f"_u_{s}") for s in sfx[1:]), F.col(f"_u_{sfx[0]}"))
    ts = sum((F.col(f"_s_{s}") for s in sfx[1:]), F.col(f"_s_{sfx[0]}"))
    return g.where(F.col("_spend") > 0).select(
        "Order_Month",
        *[F.coalesce(_fdiv(f"_u_{s}", tu) * 100.0, F.lit(0.0)).alias(f"Units_Pct_{s}") for s in sfx],
        *[F.coalesce(_fdiv(f"_s_{s}", ts) * 100.0, F.lit(0.0)).alias(f"Spend_Pct_{s}") for s in sfx],
    )


def brand_spend_by_month(acq: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """absolute basket spend per brand and month, with the month total."""
    sfx = [s for _, s in cfg.brands]
    g = acq.groupBy("Order_Month").agg(
        *[F.coalesce(F.sum(f"Basket_{s}_Spend_Amnt"), F.lit(0)).alias(f"Spend_{s}") for s in sfx],
        F.sum("Total_Customer_Spending").alias("_spend"),
    )
    total = sum((F.col(f"Spend_{s}") for s in sfx[1:]), F.col(f"Spend_{sfx[0]}"))
    return g.where(F.col("_spend") > 0).select("Order_Month", *[f"Spend_{s}" for s in sfx],
                                               total.alias("Total_Spend"))


def share_by_phase(acq: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """new / returning buyers per phase plus a whole-period row (rollup).

    Counts are buyer-months: a buyer returning in two months counts twice.
    """
    df = acq.withColumn("Phase", phase_of_month("Order_Month", cfg.phases))
    g = df.rollup("Phase").agg(
        F.coalesce(F.sum(F.when(_kind() == "new", F.col("Num_Of_Customers"))), F.lit(0)).alias("New_Customers"),
        F.coalesce(F.sum(F.when(_kind() == "ret", F.col("Num_Of_Customers"))), F.lit(0)).alias("Returning_Customers"),
        F.grouping("Phase").alias("_all"),
    )
    both = F.col("New_Customers") + F.col("Returning_Customers")
    return g.select(
        F.when(F.col("_all") == 1, F.lit(C.WHOLE_PERIOD)).otherwise(F.col("Phase")).alias("Phase"),
        "New_Customers", "Returning_Customers",
        (_fdiv("New_Customers", both) * 100.0).alias("Pct_New"),
        (_fdiv("Returning_Customers", both) * 100.0).alias("Pct_Returning"),
    )


def aov_basket_by_month(acq: DataFrame) -> DataFrame:
    """purchase value and basket size of new vs returning buyers."""
    g = acq.groupBy("Order_Month").agg(
        _of("new", "Average_Purchase_Value").alias("New_APV"),
        _of("ret", "Average_Purchase_Value").alias("Returning_APV"),
        _of("new", "Avg_Basket_Size").alias("New_Basket_Size"),
        _of("ret", "Avg_Basket_Size").alias("Returning_Basket_Size"),
        F.sum("Total_Customer_Spending").alias("_spend"),
    )
    return g.where(F.col("_spend") > 0).drop("_spend")


def cancellation_by_month(acq: DataFrame) -> DataFrame:
    """cancellation rate of new vs returning buyers per active month."""
    g = acq.groupBy("Order_Month").agg(
        _of("new", "Cancellation_Rate").alias("New_Cancellation_Rate"),
        _of("ret", "Cancellation_Rate").alias("Returning_Cancellation_Rate"),
        F.sum("Total_Customer_Spending").alias("_spend"),
    )
    return g.where(F.col("_spend") > 0).drop("_spend")


def acquisition_by_month(acq: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """new buyers per month (NULL when none) and the month's phase."""
    return acq.groupBy("Order_Month").agg(_of("new", "Num_Of_Customers").alias("New_Customers")).withColumn(
        "Phase", phase_of_month("Order_Month", cfg.phases))


def new_vs_returning(acq: DataFrame) -> DataFrame:
    """F8: new and returning buyers per month (NULL where a kind is absent)."""
    return acq.groupBy("Order_Month").agg(
        _of("new", "Num_Of_Customers").alias("New_Customers"),
        _of("ret", "Num_Of_Customers").alias("Returning_Customers"),
    )


def spending_asymmetry(acq: DataFrame) -> DataFrame:
    """returning buyers' share of heads vs share of spend; multiple = spend / heads."""
    r = acq.where((_kind() == "ret") & F.col("Pct_Total_Customer_Spending").isNotNull())
    return r.select(
        "Order_Month", "Pct_Num_Of_Customers", "Pct_Total_Customer_Spending",
        _fdiv("Pct_Total_Customer_Spending", "Pct_Num_Of_Customers").alias("Spend_Multiple"),
    )


def apv_frequency_ratio(acq: DataFrame) -> DataFrame:
    """returning / new for purchase value and buying frequency, months
    with returning buyers; flags where frequency is the larger lever."""
    g = acq.groupBy("Order_Month").agg(
        _of("new", "Average_Purchase_Value").alias("_apv_new"),
        _of("ret", "Average_Purchase_Value").alias("_apv_ret"),
        _of("new", "Buying_Frequency").alias("_f_new"),
        _of("ret", "Buying_Frequency").alias("_f_ret"),
    ).where(F.col("_apv_ret").isNotNull())
    g = g.select("Order_Month", _fdiv("_apv_ret", "_apv_new").alias("APV_Ratio"),
                 _fdiv("_f_ret", "_f_new").alias("Frequency_Ratio"))
    return g.withColumn("Frequency_Is_Larger_Lever", F.col("Frequency_Ratio") > F.col("APV_Ratio"))


def basket_mix(acq: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG, kind: str | None = None) -> DataFrame:
    """% of basket units per funnel brand and the rest, by month and kind."""
    df = acq.withColumn("Kind", _kind())
    if kind is not None:
        df = df.where(F.col("Kind") == kind)
    pcts = {b: F.coalesce(F.col(f"Basket_Pct_{cfg.brand_suffix(b)}_Products"), F.lit(0.0)) for b in cfg.funnel_brands}
    other = F.lit(100.0) - sum(pcts.values(), F.lit(0.0))
    return df.select("Order_Month", "Kind", *[c.alias(f"Pct_{b}") for b, c in pcts.items()],
                     other.alias("Pct_Other"))


def spend_per_head(acq: DataFrame) -> DataFrame:
    """spend per buyer for each month and acquisition type."""
    return acq.select("Order_Month", "Acquisition_Type",
                      _fdiv("Total_Customer_Spending", "Num_Of_Customers").alias("Spend_Per_Head"))


def purchasing_power(acq: DataFrame, from_month: str | None = None, months: list | None = None) -> DataFrame:
    """F13 (with P15): per month from ``from_month`` on, and in the list
    ``months`` if given, where both kinds exist: spend efficiency (% spend /
    % buyers), purchase value x frequency and the returning / new ratios."""
    df = acq if from_month is None else acq.where(F.col("Order_Month") >= from_month)
    df = df if months is None else df.where(F.col("Order_Month").isin(*months))
    g = df.groupBy("Order_Month").agg(
        _of("new", "Pct_Total_Customer_Spending").alias("_ps_n"), _of("new", "Pct_Num_Of_Customers").alias("_pc_n"),
        _of("ret", "Pct_Total_Customer_Spending").alias("_ps_r"), _of("ret", "Pct_Num_Of_Customers").alias("_pc_r"),
        _of("new", "Average_Purchase_Value").alias("_apv_n"), _of("ret", "Average_Purchase_Value").alias("_apv_r"),
        _of("new", "Buying_Frequency").alias("_f_n"), _of("ret", "Buying_Frequency").alias("_f_r"),
        F.count(F.when(_kind() == "new", 1)).alias("_has_n"), F.count(F.when(_kind() == "ret", 1)).alias("_has_r"),
    ).where((F.col("_has_n") > 0) & (F.col("_has_r") > 0))
    power_n = F.col("_apv_n").cast("double") * F.col("_f_n")
    power_r = F.col("_apv_r").cast("double") * F.col("_f_r")
    return g.select(
        "Order_Month",
        _fdiv("_ps_n", "_pc_n").alias("Efficiency_New"),
        _fdiv("_ps_r", "_pc_r").alias("Efficiency_Returning"),
        _fdiv("_apv_r", "_apv_n").alias("APV_Ratio"),
        _fdiv("_f_r", "_f_n").alias("Frequency_Ratio"),
        power_n.alias("Power_New"), power_r.alias("Power_Returning"),
        _fdiv(power_r, power_n).alias("Power_Ratio"),
    )
