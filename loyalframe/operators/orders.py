"""A1 — one row per order (``total_orders_data``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.functions import minute_text


def brand_measures(cfg: LoyaltyConfig):
    """Column names of the per-brand basket measures, in output order."""
    sfx = [s for _, s in cfg.brands]
    return (
        [f"Basket_Num_{s}_Products" for s in sfx],
        [f"Basket_{s}_Spend_Amnt" for s in sfx],
        [f"Basket_Total_{s}_Packsize" for s in sfx],
    )


ORDER_FIELDS = ("Order_Amount", "Order_Status", "Order_Ts", "Buyer_Username")


def one_version_per_order(lines: DataFrame) -> DataFrame:
    """The lines with the order-level fields of one line of their order.

    An export repeats an order's amount, status, time and buyer on each of
    its lines. Where they differ, all lines of the order take the fields of
    one whole line, the largest by (minute, status, amount, buyer), a null
    being the least: fields of different lines are never mixed. Orders whose
    lines differ are found by an aggregate with numeric buffers (a hash of
    the fields, least and largest per order); only their lines are compared,
    and joined back by a join whose size the planner checks.
    """
    fields = ("_Minute", *(c for c in ("Order_Status", "Order_Amount", "Buyer_Username") if c in lines.columns))
    keyed = lines.withColumn("_Minute", F.date_trunc("minute", F.col("Created_At")))
    h = F.xxhash64(*fields, *[F.col(c).isNull() for c in fields])  # a null alone does not change the hash
    seen = keyed.select("Order_ID", h.alias("_h")).groupBy("Order_ID").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    mixed = seen.where("_lo != _hi").select(F.col("Order_ID").alias("_id"))
    of = lambda id_: F.col("Order_ID").eqNullSafe(F.col(id_))
    best = keyed.join(mixed, of("_id"), "left_semi").groupBy(F.col("Order_ID").alias("_of")).agg(
        F.max(F.struct(*fields, "Created_At")).alias("_best"))
    taken = lambda c: F.when(F.col("_best").isNull(), F.col(c)).otherwise(F.col("_best")[c])
    out = lines.join(best, of("_of"), "left")
    return out.select(*[taken(c).alias(c) if c in (*fields, "Created_At") else F.col(c) for c in lines.columns])


def orders_frame(lines: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG, counts: bool = False) -> DataFrame:
    """Aggregate labelled lines to orders; ``Order_Ts`` is the minute-truncated time.

    One hash aggregate by order id and the order-level fields (amount,
    status, time, buyer), with numeric buffers and map-side combine; where
    the lines are already partitioned by ``Order_ID``, as after the orders
    join, it does not shuffle. The lines of an order must agree in these
    fields: lines joined to an order table do, lines of an export do after
    :func:`one_version_per_order`. An order without any buyer goes to one
    pseudo buyer. ``counts`` adds the order's number of lines and of lines
    without a label (``Has_Label`` false), so that both are known for all
    lines from the order table alone.
    """
    brand = F.col("Brand")
    after = F.col("SKU_Subtotal_After_Discount")
    n_cols, s_cols, k_cols = brand_measures(cfg)
    aggs = [F.sum(after).alias("Sum_SKU_Subtotal_After_Discount")]
    aggs += [F.count(F.when(brand == b, 1)).alias(n) for (b, _), n in zip(cfg.brands, n_cols)]
    aggs += [F.sum(F.when(brand == b, after)).alias(s) for (b, _), s in zip(cfg.brands, s_cols)]
    aggs += [F.sum(F.when(brand == b, F.col("Pack_Size"))).alias(k) for (b, _), k in zip(cfg.brands, k_cols)]
    line_counts = []
    if counts:
        line_counts = ["Num_Lines", "Num_Unlabelled_Lines"]
        aggs += [F.count(F.lit(1)).alias("Num_Lines"),
                 F.count(F.when(~F.col("Has_Label") & F.col("SKU_ID").isNotNull(), 1)).alias("Num_Unlabelled_Lines")]
    out = lines.withColumn("Order_Ts", F.date_trunc("minute", F.col("Created_At"))).groupBy("Order_ID", *ORDER_FIELDS).agg(*aggs)
    return out.select(
        "Order_ID", "Order_Amount", "Order_Status", "Order_Ts",
        F.coalesce(F.col("Buyer_Username"), F.lit(cfg.no_username)).alias("Buyer_Username"),
        "Sum_SKU_Subtotal_After_Discount",
        (F.col("Sum_SKU_Subtotal_After_Discount") - F.col("Order_Amount")).alias("Different_Amount"),
        *n_cols, *s_cols, *k_cols, *line_counts,
    )


def total_orders_data(orders: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG, *more: str) -> DataFrame:
    """Published shape of A1 (``Order_Time`` as ``YYYY-MM-DD HH:MM`` text), with further columns of ``orders``."""
    n_cols, s_cols, k_cols = brand_measures(cfg)
    return orders.select(
        "Order_ID", "Order_Amount", "Order_Status", minute_text("Order_Ts").alias("Order_Time"),
        "Buyer_Username", "Sum_SKU_Subtotal_After_Discount", "Different_Amount",
        *n_cols, *s_cols, *k_cols, *more,
    )
