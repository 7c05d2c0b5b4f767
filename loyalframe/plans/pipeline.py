"""The dataset graph: lines -> orders -> customers / monthly -> summaries.

``LoyaltyData`` builds each shared intermediate once per instance
(lazily, as a DataFrame plan). ``persist()`` keeps them across several
actions; ``checkpoint()`` cuts the lineage at the order table by writing
it as Parquet to ``spark.checkpoint.dir`` (shared storage on a cluster), so
a lost executor recomputes from there instead of from the raw lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache, cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig, EXPORT_TIME_FORMAT
from loyalframe.operators.customers import customers_frame
from loyalframe.operators.labelling import flag_gifts, hot_product_ids, prepared_lines
from loyalframe.operators.monthly import monthly_frame
from loyalframe.operators.orders import one_version_per_order, orders_frame
from loyalframe.operators.switching import customer_cube
from loyalframe.session import ensure_checkpoint_dir, require_utc
from loyalframe.sources.adapter import (
    labelled_order_lines_from_tables, order_lines_from_tables, product_labels_from_tables, read_table,
)


class LoyaltyData:
    hot_ids: tuple = ()

    def __init__(self, lines: DataFrame, labels: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG,
                 hot_share: float | None = None):
        """``hot_share``: count the lines per product first and deal those above this share over all tasks of the label join."""
        self.spark = lines.sparkSession
        require_utc(self.spark)
        if hot_share is not None:
            self.hot_ids = hot_product_ids(lines, hot_share)
        self.raw_lines = lines
        self.labels = labels
        self.cfg = cfg

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> "LoyaltyData":
        """Plan graph over the benchmark tables, as they are now."""
        return TableData(spark, sf_dir, cfg)

    @cached_property
    def lines(self) -> DataFrame:
        """Labelled lines; the lines of an order agree in its fields."""
        return prepared_lines(one_version_per_order(self.raw_lines), self.labels, self.cfg, hot_ids=self.hot_ids)

    def flagged_lines(self, flag: str) -> DataFrame:
        """The same lines with a boolean column that tells whether a line has a label."""
        return prepared_lines(one_version_per_order(self.raw_lines), self.labels, self.cfg, flag=flag, hot_ids=self.hot_ids)

    @cached_property
    def orders(self) -> DataFrame:
        return orders_frame(self.lines, self.cfg)

    def by_buyer(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A dataset whose rows each belong to one buyer, built from the orders."""
        return build(self.orders)

    @cached_property
    def customers(self) -> DataFrame:
        return self.by_buyer(lambda orders: customers_frame(orders, self.cfg))

    @cached_property
    def monthly(self) -> DataFrame:
        return self.by_buyer(lambda orders: monthly_frame(orders, self.cfg))

    @property
    def buyers(self) -> DataFrame:
        """What summaries over buyers read: the cube once :meth:`write_cube` has run, else the buyers."""
        return self.__dict__.get("cube", self.customers)

    def write_cube(self) -> "LoyaltyData":
        """Sum the buyers up once; the summaries over buyers (A3, A7-A11, A13, A14) then read only that."""
        self.__dict__["cube"] = written(customer_cube(self.customers, self.cfg), "customer_cube")
        return self

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "LoyaltyData":
        for name in ("lines", "orders", "customers", "monthly"):
            self.__dict__[name] = getattr(self, name).persist(level)
        return self

    def checkpoint(self, lines: bool = False, customers: bool = False) -> "LoyaltyData":
        """Write the order table (and with ``lines`` the labelled lines first)
        as Parquet to the shared folder ``spark.checkpoint.dir``; later
        datasets, and recovery after a lost executor, start from there and
        read only the columns they need. With ``customers`` the buyers are
        written too: several datasets over buyers then aggregate them once."""
        if lines:
            self.__dict__["lines"] = written(self.lines, "lines")
            self.__dict__.pop("orders", None)
        self.__dict__["orders"] = written(self.orders, "orders")
        for name in ("customers", "monthly", "cube"):
            self.__dict__.pop(name, None)
        if customers:
            self.__dict__["customers"] = written(self.customers, "customers")
        return self


class TableData(LoyaltyData):
    """The graph over the benchmark tables. A dataset builds only the frames
    it needs, and each table is looked up once per graph."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: LoyaltyConfig = DEFAULT_CONFIG):
        self.spark = spark
        require_utc(spark)
        self.tables = (spark, sf_dir, cache(read_table))
        self.cfg = cfg

    @cached_property
    def raw_lines(self) -> DataFrame:
        return order_lines_from_tables(*self.tables)

    @cached_property
    def labels(self) -> DataFrame:
        return product_labels_from_tables(*self.tables)

    @cached_property
    def lines(self) -> DataFrame:
        """The same lines as ``prepared_lines(raw_lines, labels)``, with the
        joins ordered so the order aggregate reuses a partitioning. Each
        order's fields come from its one row of ``orders``, so its lines agree."""
        return self._labelled(None)

    def flagged_lines(self, flag: str) -> DataFrame:
        return self._labelled(flag)

    def _labelled(self, flag: str | None) -> DataFrame:
        spark, sf_dir, read = self.tables
        return flag_gifts(labelled_order_lines_from_tables(spark, sf_dir, self.labels, read, flag), self.cfg)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loyalframe-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def present_lines(lines: DataFrame) -> DataFrame:
    """Order lines as the export shows them: ``Created_Time`` text."""
    if "Created_Time" in lines.columns:  # read from an export: keep its own text
        return lines.drop("Created_At")
    cols = [c for c in lines.columns if c != "Created_At"]
    return lines.select(
        *cols[:4], F.date_format("Created_At", EXPORT_TIME_FORMAT).alias("Created_Time"), *cols[4:]
    )
