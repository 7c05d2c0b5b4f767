"""A stored layout for many questions on the same lines: months as partitions, orders bucketed by buyer.

Lines are written once, partitioned by ``Order_Month``: a question about some
months opens only their folders. Orders of named buyers are written once
as a table bucketed by buyer (one shuffle), so that every buyer-level dataset
(customers, monthly data, second purchase) reads it without an exchange.
Buyer-less orders form one pseudo buyer that may hold a third of all orders;
in a bucketed table they would be one task. They are stored beside it, in no
bucket, and aggregated with map-side combine; as no named buyer is among
them, the two parts of a buyer-level dataset are simply united.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.functions import month_text
from loyalframe.plans.pipeline import LoyaltyData
from loyalframe.sources.sinks import MONTH


class StoredData(LoyaltyData):
    """The dataset graph over a stored layout; see :func:`store`."""

    def __init__(self, data: LoyaltyData, lines_path: str, orders_table: str, nameless_path: str):
        self.spark, self.cfg, self.raw_lines, self.labels = data.spark, data.cfg, data.raw_lines, data.labels
        self._paths = lines_path, orders_table, nameless_path

    @cached_property
    def lines(self) -> DataFrame:
        return self.spark.read.parquet(self._paths[0])

    @cached_property
    def named_orders(self) -> DataFrame:
        return self.spark.table(self._paths[1])

    @cached_property
    def nameless_orders(self) -> DataFrame:
        return self.spark.read.parquet(self._paths[2])

    @cached_property
    def orders(self) -> DataFrame:
        return self.named_orders.unionByName(self.nameless_orders)

    def by_buyer(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return build(self.named_orders).unionByName(build(self.nameless_orders))


def store(data: LoyaltyData, path: str, buckets: int = 64) -> StoredData:
    """Write lines and orders of ``data`` below ``path``, a shared folder, and return the graph over them.

    ``buckets`` is the number of tasks of a buyer-level dataset later on:
    choose it so that a bucket of the orders is some 200 MB. The bucketed
    table is registered in the session's catalogue under a new name; its
    files are below ``path``.
    """
    root = path.rstrip("/")
    month = lambda c: month_text(F.col(c)).alias(MONTH)
    data.lines.select("*", month("Created_At")).write.mode("overwrite").partitionBy(MONTH).parquet(f"{root}/lines")
    # the orders from the stored lines: they are read once more, labelled already
    fixed = LoyaltyData(data.raw_lines, data.labels, data.cfg)
    fixed.__dict__["lines"] = data.spark.read.parquet(f"{root}/lines").drop(MONTH)
    orders = fixed.orders.select("*", month("Order_Ts"))
    orders.write.mode("overwrite").parquet(f"{root}/all_orders")
    orders = data.spark.read.schema(orders.schema).parquet(f"{root}/all_orders")
    nameless = F.col("Buyer_Username") == data.cfg.no_username
    name = f"loyalframe_orders_{uuid.uuid4().hex}"
    (orders.where(~nameless).repartition(buckets, "Buyer_Username").write.mode("overwrite").option("path", f"{root}/orders")
     .partitionBy(MONTH).bucketBy(buckets, "Buyer_Username").sortBy("Buyer_Username").saveAsTable(name))
    orders.where(nameless).write.mode("overwrite").partitionBy(MONTH).parquet(f"{root}/nameless_orders")
    return StoredData(data, f"{root}/lines", name, f"{root}/nameless_orders")
