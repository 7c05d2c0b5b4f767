"""Adapter from the benchmark tables (lineitem/orders/part) to the shop shape.

The shop export has one row per SKU line of an order and a product label
table; the benchmark tables carry the same structure (order -> lines ->
part), so order lines and labels are derived from them with the mapping
below. The same mapping is written as SQL in the oracle, so both sides
start from identical input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalframe.config import CANCELLED_STATUS, EXPORT_TIME_FORMAT
from loyalframe.operators.labelling import LABEL_COLUMNS, ROW_TAG, label_order_lines

DONE_STATUS = "Đã hoàn tất"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One benchmark table. Looking up a Parquet folder's schema is a Spark
    job, so callers that derive several frames pass one caching reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Reader = Callable[[SparkSession, str, str], DataFrame]

LINE_PARTITIONS = "spark.loyalframe.linePartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan on ``key`` when the caller asks for it.

    For files written as one big row group, which scan as one task: the
    session setting ``spark.loyalframe.linePartitions`` names the number of
    partitions. With the key of the next aggregate (``Order_ID`` for the
    order lines) the broadcast joins in between keep that partitioning and
    the aggregate needs no shuffle of its own. Unset, as on a cluster with
    many files, the plan is the plain scan at every size.
    """
    n = df.sparkSession.conf.get(LINE_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def _money(c) -> F.Column:
    return F.round(c * 100).cast("bigint")


def _line_tables(spark: SparkSession, sf_dir: str, read: Reader) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lineitem, orders and part, each keyed by the expression
    the later steps partition by: ``Order_ID`` for orders (the order
    aggregate's key; the text of a bigint is unique, so this equals the
    key equality) and ``trim(SKU_ID)`` for part (the label join's key)."""
    l = spread(read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("Order_ID"),
        "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    ), "Order_ID").withColumn("SKU_ID", F.col("l_partkey").cast("string"))
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_o_id"),
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_p_id"), "p_retailprice")
    return l, o, p


def _shop_columns() -> list:
    """The export's columns computed from the joined benchmark columns."""
    ext = F.col("l_extendedprice")
    disc_amt = _money(ext * F.col("l_discount"))
    zero_line = (F.col("l_partkey") % 17) == 0
    created = (
        F.col("o_orderdate").cast("timestamp")
        + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    )
    return [
        "Order_ID",
        "SKU_ID",
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), F.lit(CANCELLED_STATUS))
        .otherwise(F.lit(DONE_STATUS))
        .alias("Order_Status"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.lit("Normal"))
        .alias("Normal_Or_Pre_order"),
        created.alias("Created_At"),
        F.when(F.col("o_custkey") % 97 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"), F.lit("_"),
                            (F.col("o_orderkey") % 8).cast("string")))
        .alias("Buyer_Username"),
        F.col("l_quantity").cast("bigint").alias("Quantity"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit(0).cast("bigint"))
        .otherwise(_money(F.col("o_totalprice")))
        .alias("Order_Amount"),
        _money(F.col("p_retailprice")).alias("SKU_Unit_Original_Price"),
        F.when(zero_line, F.lit(0).cast("bigint")).otherwise(_money(ext)).alias("SKU_Subtotal_Before_Discount"),
        disc_amt.alias("SKU_Seller_Discount"),
        F.when(zero_line, F.lit(0).cast("bigint")).otherwise(_money(ext) - disc_amt)
        .alias("SKU_Subtotal_After_Discount"),
    ]


def order_lines_from_tables(spark: SparkSession, sf_dir: str, read: Reader = read_table) -> DataFrame:
    """Order lines (reference shape, typed) from lineitem ⋈ orders ⋈ part.

    Both joins are many-to-one on a key; the planner broadcasts ``orders``
    / ``part`` only while they are under the broadcast threshold and
    sort-merges otherwise (all three are large at scale).
    """
    l, o, p = _line_tables(spark, sf_dir, read)
    j = l.join(o, l.Order_ID == o._o_id).join(p, F.trim(l.SKU_ID) == p._p_id)
    return j.select(*_shop_columns())


def labelled_order_lines_from_tables(spark: SparkSession, sf_dir: str, labels: DataFrame,
                                     read: Reader = read_table, flag: str | None = None) -> DataFrame:
    """The same order lines with the product labels, joins ordered for scale.

    Equal to labelling :func:`order_lines_from_tables` (the inner joins
    commute with the label join, which is keyed on the product alone),
    but the product-keyed joins come first and the orders join last.
    When nothing broadcasts, the lines are then shuffled once by product
    (part and label joins share that partitioning) and once by order id,
    and the order aggregate reuses the orders join's partitioning; joining
    orders first would scatter an order's lines over the product shuffle
    and cost the aggregate a third, nearly full-size shuffle.
    """
    l, o, p = _line_tables(spark, sf_dir, read)
    lp = label_order_lines(l.join(p, F.trim(l.SKU_ID) == p._p_id), labels, flag=flag)
    j = lp.join(o, lp.Order_ID == o._o_id)
    return j.select(*_shop_columns(), *LABEL_COLUMNS, *([flag] if flag else []))


def export_text_from_tables(spark: SparkSession, sf_dir: str, read: Reader = read_table) -> DataFrame:
    """The order lines as an export writes them: every cell text.

    Whole numbers come as ``200`` on odd line quantities and ``200.0`` on
    even ones, and lines of every 11th product have a quantity that is no
    number.
    """
    lines = order_lines_from_tables(spark, sf_dir, read)
    even = F.col("Quantity") % 2 == 0
    number = lambda c: F.concat(F.col(c).cast("string"), F.when(even, ".0").otherwise(""))
    bad = F.col("SKU_ID").cast("bigint") % 11 == 0
    money = [c for c in lines.columns if c.startswith("SKU_S") or c.startswith("SKU_U") or c == "Order_Amount"]
    return lines.withColumns({
        "Created_Time": F.date_format("Created_At", EXPORT_TIME_FORMAT),
        **{c: number(c) for c in money}, "Quantity": F.when(bad, "n/a").otherwise(number("Quantity")),
    }).drop("Created_At")


def label_rows_from_tables(spark: SparkSession, sf_dir: str, read: Reader = read_table) -> DataFrame:
    """Label rows with an older row for every third product, tagged in file order."""
    new = product_labels_from_tables(spark, sf_dir, read)
    old = new.where(F.col("ID").cast("bigint") % 3 == 0).withColumns({"Category": F.lit("old"), "Brand": F.lit("old")})
    tag = lambda df, n: df.withColumn(ROW_TAG, F.lit(n))
    return tag(old, 0).unionByName(tag(new.withColumn("ID", F.concat(F.lit(" "), "ID", F.lit(" "))), 1))


def product_labels_from_tables(spark: SparkSession, sf_dir: str, read: Reader = read_table) -> DataFrame:
    """Label table (ID + six labels) from ``part``; 10 % of parts unlabelled."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_name", "p_brand")
    k = F.col("p_partkey") % 10
    brand = (
        F.when(k < 4, "Kinka").when(k < 6, "Revy").when(k == 6, "SiMee").when(k == 7, "Y tế")
        .otherwise("IONCare")
    )
    return p.where(k != 9).select(
        F.col("p_partkey").cast("string").alias("ID"),
        F.col("p_type").alias("Category"),
        F.concat(F.col("p_type"), F.lit("/"), (F.col("p_size") % 5).cast("string")).alias("Sub_category"),
        F.col("p_name").alias("Product_SKU_Name"),
        F.col("p_brand").alias("Product_Variant"),
        brand.alias("Brand"),
        F.col("p_size").cast("bigint").alias("Pack_Size"),
    )
