"""Incremental rebuild of the order, customer and monthly datasets (A1-A5) from new exports.

The shop rebuilt every dataset from the whole export on each run. Here an
export changes only what it touches. The order table is partitioned by a
bucket of the buyer, so that all orders of a buyer, and with them the buyer's
customer row and monthly rows, belong to one bucket; an index from order id
to bucket tells where an order stood before. A batch of lines becomes
changed orders; their old and new buckets are the affected ones; only these
partitions are read, rebuilt and overwritten (dynamic partition overwrite).
The two small summaries (A3, A5) are rebuilt from the buyer-level tables.

Buyer-less orders form one pseudo buyer that may hold a third of all orders:
they are spread over buckets of their own by order id. Its few customer and
monthly rows are aggregated from these buckets (partial aggregates, no hot
task) when one of them changed.

A batch is applied exactly once in effect. Everything is computed from the
tables as they were and written to a folder of the batch; only then are
partitions overwritten from there. A batch that is run again after a failure
repeats the overwrite from its folder, whatever the first attempt left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.operators.customers import customers_frame, total_customers_data
from loyalframe.operators.monthly import monthly_customers_data, monthly_frame
from loyalframe.operators.orders import one_version_per_order, orders_frame, total_orders_data
from loyalframe.operators.segments import pivot_loyalty_tier, pivot_monthly_customers_acquisition
from loyalframe.session import apply_session_conf, ensure_checkpoint_dir, require_utc
from loyalframe.streaming.ingest import EXPORT_FILE, EXPORT_TIME, order_line_stream

BUCKET, ORDER_BUCKET, LIVE = "Buyer_Bucket", "Order_Bucket", "_Live"
TABLES = ("orders", "order_index", "customers", "monthly")
KEY = {"orders": BUCKET, "order_index": ORDER_BUCKET, "customers": BUCKET, "monthly": BUCKET}


class Rebuild:
    """The tables below ``root``. ``buckets`` and ``spread`` (buckets of the
    pseudo buyer, ``order_buckets`` of the index) are fixed when the tables
    are first written; choose them so that a partition is some 100 MB."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, spread: int = 32, order_buckets: int = 64,
                 cfg: LoyaltyConfig = DEFAULT_CONFIG):
        require_utc(spark)
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.buckets, self.spread, self.order_buckets = buckets, spread, order_buckets

    # where rows belong

    def _nameless(self) -> Column:
        return F.col("Buyer_Username") == self.cfg.no_username

    def bucket_of_order(self) -> Column:
        own = F.pmod(F.xxhash64("Buyer_Username"), F.lit(self.buckets))
        return F.when(self._nameless(), self.buckets + F.pmod(F.xxhash64("Order_ID"), F.lit(self.spread))).otherwise(own).cast("int")

    def bucket_of_buyer(self) -> Column:
        return F.when(self._nameless(), self.buckets).otherwise(F.pmod(F.xxhash64("Buyer_Username"), F.lit(self.buckets))).cast("int")

    def bucket_of_id(self) -> Column:
        return F.pmod(F.xxhash64("Order_ID"), F.lit(self.order_buckets)).cast("int")

    # tables

    def exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str, parts: list | None = None) -> DataFrame | None:
        """A table, or its named partitions only (pruned before any file is opened); None before the first batch."""
        path = f"{self.root}/{name}"
        if not self.exists(path):
            return None
        df = self.spark.read.parquet(path)
        return (df if parts is None else df.where(F.col(KEY[name]).isin(parts))).where(LIVE).drop(LIVE)

    def _overwrite(self, name: str, staged: str) -> None:
        (self.spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(KEY[name]).parquet(f"{self.root}/{name}"))

    def _stage(self, df: DataFrame, name: str, parts: list, batch: str) -> None:
        """Write the new content of ``parts``; a mark per partition makes sure that an emptied one is overwritten too."""
        marks = self.spark.createDataFrame([(int(p),) for p in parts], f"{KEY[name]} int").withColumn(LIVE, F.lit(False))
        rows = df.withColumn(KEY[name], F.col(KEY[name]).cast("int")).withColumn(LIVE, F.lit(True)).unionByName(marks, allowMissingColumns=True)
        rows.repartition(F.col(KEY[name])).write.mode("overwrite").parquet(f"{batch}/{name}")

    # one batch

    def changed_orders(self, lines: DataFrame) -> DataFrame:
        """The batch's orders, each from the newest export in it that has it, with bucket and export."""
        lines = lines.where("Order_ID IS NOT NULL")
        newest = lines.groupBy("Order_ID").agg(F.max(F.struct(EXPORT_TIME, EXPORT_FILE)).alias("_Version"))
        lines = lines.join(newest, "Order_ID").where(F.col("_Version") == F.struct(EXPORT_TIME, EXPORT_FILE)).drop("_Version")
        orders = orders_frame(one_version_per_order(lines), self.cfg).join(newest, "Order_ID")
        return orders.withColumn(BUCKET, self.bucket_of_order()).withColumn(ORDER_BUCKET, self.bucket_of_id())

    def apply(self, lines: DataFrame, batch_id: int | str) -> None:
        """Apply one batch of labelled lines (the columns of ``order_line_stream``)."""
        batch = f"{self.root}/batches/{batch_id}"
        if not self.exists(f"{batch}/done"):
            self._compute(lines, batch)
        for name in TABLES:
            if self.exists(f"{batch}/{name}"):
                self._overwrite(name, f"{batch}/{name}")

    def _compute(self, lines: DataFrame, batch: str) -> None:
        lines.where("Order_ID IS NULL").write.mode("overwrite").parquet(f"{batch}/lines_without_order")
        self.changed_orders(lines).write.mode("overwrite").parquet(f"{batch}/changed")
        changed = self.spark.read.parquet(f"{batch}/changed")
        ids = _values(changed, ORDER_BUCKET)
        index = self.table("order_index", ids)
        if index is not None:
            before = index.select("Order_ID", F.col(BUCKET).alias("_Old"), F.col("_Version").alias("_Old_Version"))
            # an export older than what is known of an order changes nothing
            changed = changed.join(before, "Order_ID", "left").where("_Old_Version IS NULL OR _Version >= _Old_Version").drop("_Old_Version")
        else:
            changed = changed.withColumn("_Old", F.lit(None).cast("int"))
        affected = sorted({*_values(changed, BUCKET), *_values(changed, "_Old")})  # at most all buckets' numbers
        if affected:
            known = self.table("orders", affected)
            new = changed.drop("_Old", ORDER_BUCKET)
            orders = new if known is None else known.join(new.select("Order_ID"), "Order_ID", "left_anti").unionByName(new)
            self._stage(orders, "orders", affected, batch)
            entries = changed.select("Order_ID", BUCKET, "_Version", ORDER_BUCKET)
            if index is not None:
                entries = index.join(entries.select("Order_ID"), "Order_ID", "left_anti").unionByName(entries)
            self._stage(entries, "order_index", ids, batch)
            self._stage_buyers(affected, batch)
        self.spark.range(1).write.mode("overwrite").parquet(f"{batch}/done")

    def _stage_buyers(self, affected: list, batch: str) -> None:
        nameless = [self.buckets + i for i in range(self.spread)]
        orders = self.spark.read.parquet(f"{batch}/orders").where(LIVE).drop(LIVE)
        parts = [b for b in affected if b < self.buckets]
        if any(b >= self.buckets for b in affected):
            parts.append(self.buckets)
            rest = self.table("orders", [b for b in nameless if b not in affected])
            orders = orders if rest is None else orders.unionByName(rest)
        customers = customers_frame(orders, self.cfg).withColumn(BUCKET, self.bucket_of_buyer())
        monthly = monthly_frame(orders, self.cfg).withColumn(BUCKET, self.bucket_of_buyer())
        self._stage(customers, "customers", parts, batch)
        self._stage(monthly, "monthly", parts, batch)

    # published datasets

    def datasets(self) -> dict[str, DataFrame]:
        """A1-A5 as they are after the last batch."""
        orders, customers, monthly = (self.table(n) for n in ("orders", "customers", "monthly"))
        return {
            "total_orders_data": total_orders_data(orders, self.cfg),
            "total_customers_data": total_customers_data(customers, self.cfg),
            "pivot_loyalty_tier": pivot_loyalty_tier(customers, self.cfg),
            "monthly_customers_data": monthly_customers_data(monthly, self.cfg),
            "pivot_monthly_customers_acquisition": pivot_monthly_customers_acquisition(monthly, self.cfg),
        }


def _values(df: DataFrame, column: str) -> list[int]:
    """The distinct bucket numbers in ``column``."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def start_rebuild(spark: SparkSession, export_dir: str, labels: DataFrame, root: str, checkpoint_dir: str,
                  cfg: LoyaltyConfig = DEFAULT_CONFIG, available_now: bool = True, max_files_per_trigger: int | None = None,
                  **layout) -> StreamingQuery:
    """Keep A1-A5 below ``root`` current with the exports that arrive in ``export_dir``.

    Each micro-batch of new files is one change set. The labels are those
    given at the start. ``layout``: the bucket counts of :class:`Rebuild`.
    """
    apply_session_conf(spark)
    ensure_checkpoint_dir(spark)
    tables = Rebuild(spark, root, cfg=cfg, **layout)
    stream = order_line_stream(spark, export_dir, labels, f"{checkpoint_dir.rstrip('/')}-labels", cfg,
                               max_files_per_trigger=max_files_per_trigger)
    w = stream.writeStream.foreachBatch(lambda lines, batch_id: tables.apply(lines, batch_id)).option(
        "checkpointLocation", checkpoint_dir)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
