"""Incremental ingest of order exports with Structured Streaming.

The shop re-imported its whole export on every run. As a stream, each
new export file dropped into a folder is read once, typed, labelled and
appended to the order-lines table, with the file it came from. An export
holds all orders so far, so an order comes again with each export:
:func:`current_order_lines` gives the lines of every order as its newest
export has them. Labelling is a stream-static left join against the
(de-duplicated) label table. The checkpoint folder makes the ingest
restartable: files already committed are not read again after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig
from loyalframe.operators.labelling import dedupe_labels, prepared_lines
from loyalframe.session import apply_session_conf, ensure_checkpoint_dir
from loyalframe.sources.ingest import _strip_bom, cast_order_lines, clean_headers, name_sku_column
from loyalframe.sources.sinks import CSV_QUOTES, write_dataset

EXPORT_TIME, EXPORT_FILE = "_Export_Time", "_Export_File"


def export_schema(spark: SparkSession, export_dir: str) -> T.StructType:
    """All-text schema with the header names of the exports in ``export_dir``."""
    names = spark.read.options(**CSV_QUOTES).option("header", True).option("inferSchema", False).csv(export_dir).columns
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def order_line_stream(spark: SparkSession, export_dir: str, labels: DataFrame, labels_dir: str,
                      cfg: LoyaltyConfig = DEFAULT_CONFIG, schema: T.StructType | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of typed, labelled, gift-flagged order lines.

    Columns are found by the header names of the exports present at the
    start (or by ``schema``); a later file with other headers is an error,
    never read by position. The de-duplicated label table is written once to
    ``labels_dir`` on shared storage, so every micro-batch joins the same
    fixed table.
    """
    write_dataset(dedupe_labels(labels), labels_dir)
    fixed_labels = spark.read.parquet(labels_dir)
    raw_schema = schema or export_schema(spark, export_dir)
    reader = spark.readStream.schema(raw_schema).options(**CSV_QUOTES).option("multiLine", True).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        # bounds each micro-batch: a backlog of many exports is ingested in
        # several batches (``availableNow`` honours it) rather than one
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(export_dir)
    names = name_sku_column(clean_headers(_strip_bom(raw.columns)))
    lines = raw.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names)],
        F.col("_metadata.file_modification_time").alias(EXPORT_TIME), F.col("_metadata.file_path").alias(EXPORT_FILE))
    return prepared_lines(cast_order_lines(lines), fixed_labels, cfg, dedupe=False)


def start_order_line_ingest(spark: SparkSession, export_dir: str, labels: DataFrame, out_dir: str,
                            checkpoint_dir: str, available_now: bool = True,
                            cfg: LoyaltyConfig = DEFAULT_CONFIG,
                            max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append new export files to the Parquet order-lines table at ``out_dir``.

    ``available_now`` processes what is there and stops (a scheduled
    batch); otherwise the query keeps watching the folder. The label table
    in use is kept beside the query's checkpoint.
    """
    apply_session_conf(spark)
    ensure_checkpoint_dir(spark)
    w = (order_line_stream(spark, export_dir, labels, f"{checkpoint_dir.rstrip('/')}-labels", cfg,
                           max_files_per_trigger=max_files_per_trigger)
         .writeStream.format("parquet")
         .option("path", out_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def current_order_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """The ingested lines, each order as in the newest export that has it.

    One combined aggregate finds an order's newest (time, file); its lines
    are those of that file, equal lines of one export included. Lines
    without an order id are kept from every export.
    """
    lines = spark.read.parquet(out_dir)
    newest = lines.where("Order_ID IS NOT NULL").groupBy("Order_ID").agg(
        F.max(F.struct(EXPORT_TIME, EXPORT_FILE)).alias("_newest"))
    kept = lines.join(newest, "Order_ID", "left").where(
        F.col("_newest").isNull() | (F.col("_newest") == F.struct(EXPORT_TIME, EXPORT_FILE)))
    return kept.select(*[c for c in lines.columns if c not in (EXPORT_TIME, EXPORT_FILE)])
