"""Datasets that go through files: exports read by name, quarantine, written tables read back.

Each writes below the shared folder ``spark.checkpoint.dir`` (a new folder a
call) and returns what a reader finds there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.functions import month_text
from loyalframe.operators.orders import total_orders_data
from loyalframe.plans.pipeline import LoyaltyData, present_lines
from loyalframe.session import ensure_checkpoint_dir
from loyalframe.sources.adapter import export_text_from_tables
from loyalframe.sources.ingest import EXPORT_FILE, quarantined_cells, read_order_lines, read_raw_export, split_order_lines
from loyalframe.sources.sinks import CSV_QUOTES, export_all, read_dataset, row_counts, write_dataset, write_labelled_csv

DESCRIPTION = {"Order ID": "Platform unique order ID.", "Created Time": "Order created time."}


def scratch(d: LoyaltyData, name: str) -> str:
    return f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/loyalframe-{uuid.uuid4().hex}/{name}"


def write_exports(d: LoyaltyData) -> str:
    """The order lines as CSV exports of three layouts in one folder.

    Lines of odd products come in the usual column order; those of even ones in
    the reverse order, with a note that holds a line break; one more file
    holds a header and a description row only.
    """
    text = export_text_from_tables(*d.tables)
    usual = [F.col(c).alias(c.replace("_", " ")) for c in text.columns]
    odd = F.col("SKU_ID").cast("bigint") % 2 == 1
    path = scratch(d, "exports")
    text.where(odd).select(*usual).write.options(**CSV_QUOTES).option("header", True).csv(f"{path}/usual")
    note = F.concat(F.lit("note on\n\"order\" "), F.col("Order_ID")).alias("Buyer Note")
    text.where(~odd).select(note, *reversed(usual)).write.options(**CSV_QUOTES).option("header", True).csv(f"{path}/reversed")
    names = [c.replace("_", " ") for c in text.columns]
    words = d.spark.range(1).select(*[F.lit(DESCRIPTION.get(c)).cast("string").alias(c) for c in names])
    words.write.options(**CSV_QUOTES).option("header", True).csv(f"{path}/described")
    return path


def export_files_by_name(d: LoyaltyData) -> DataFrame:
    """The typed lines of export files of different layouts."""
    return read_order_lines(d.spark, write_exports(d)).drop("Created_Time", "Buyer_Note")


def export_quarantine(d: LoyaltyData) -> DataFrame:
    """The rejected cells of the export files."""
    split = split_order_lines(read_raw_export(d.spark, write_exports(d)))
    return quarantined_cells(split.quarantine).drop(EXPORT_FILE)


def ingest_balance(d: LoyaltyData) -> DataFrame:
    """Rows read from the export files, and where they went."""
    raw = read_raw_export(d.spark, write_exports(d))
    split = split_order_lines(raw)
    return row_counts({"raw": raw, "lines": split.lines, "quarantine": split.quarantine, "descriptions": split.descriptions})


def orders_read_back(d: LoyaltyData) -> DataFrame:
    """``total_orders_data`` written by month and read back, the month as a partition column."""
    orders = total_orders_data(d.orders.withColumn("Order_Month", month_text(F.col("Order_Ts"))), d.cfg, "Order_Month")
    path = scratch(d, "total_orders_data")
    write_dataset(orders, path, partition_by=("Order_Month",))
    return read_dataset(d.spark, path, schema=orders.schema)


def labelled_csv_read_back(d: LoyaltyData) -> DataFrame:
    """The labelled lines written as CSV (gzip: plain text is most of the bytes moved) and read back with their types."""
    lines = present_lines(d.lines)
    path = scratch(d, "labelled.csv")
    write_labelled_csv(lines, path, compression="gzip")
    return read_dataset(d.spark, path, "csv", lines.schema)


def exported_row_counts(d: LoyaltyData, datasets: dict) -> DataFrame:
    """Datasets exported from one written order table and one of buyers, counted from their files."""
    d.checkpoint(customers=True)
    built = {name: build(d) for name, build in datasets.items()}
    paths = export_all({n: (lambda n=n: built[n]) for n in built}, scratch(d, "export"))
    return row_counts({n: read_dataset(d.spark, p, schema=built[n].schema) for n, p in zip(built, paths)})
