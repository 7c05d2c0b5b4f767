"""S5-S9 — writing datasets and counting them.

Every write is a plain DataFrame write with ``overwrite`` (the shop
rebuilt the whole database on every run; overwrite gives the same
"drop if exists, create as select" effect per dataset). Writes go to the
folder given — on a cluster a shared file system or object store.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MONTH = "Order_Month"  # partition column of a stored line or order table
# a quote within a quoted cell is doubled, as spreadsheets write and read it
CSV_QUOTES = {"quote": '"', "escape": '"'}


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: Iterable[str] = ()) -> None:
    """Write one dataset (optionally partitioned, e.g. by month)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_QUOTES).option("header", True)
    cols = list(partition_by)
    if cols:
        w = w.partitionBy(*cols)
    w.save(path)


def in_months(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The months ``first`` to ``last`` (``YYYY-MM``, inclusive) of a table stored by month; any other frame as it is.

    For a predicate on time that the caller states as well: this one only
    lets Spark leave out the partitions of other months.
    """
    if MONTH not in df.columns:
        return df
    if first is not None:
        df = df.where(F.col(MONTH) >= first)
    return df if last is None else df.where(F.col(MONTH) <= last)


def write_labelled_csv(df: DataFrame, path: str, header: bool = True, header_row: list | None = None,
                       bom: bool = False, order_by: Iterable[str] = (), compression: str | None = None) -> None:
    """Labelled order lines as CSV, with or without a header row.

    ``order_by`` names columns (an export's ``EXPORT_ORDER``) whose order the
    part files keep, one after the other by name: the rows are dealt to tasks
    by ranges of them, never gathered. These columns are not written.
    ``header_row`` gives the header's texts (one per column, duplicates
    allowed only as Spark allows them); ``bom`` marks the files as UTF-8 for
    spreadsheet programs, on the header of each part file. ``compression``
    ("gzip") makes compressed part files, which readers take like plain ones;
    each is then read by one task, as it was written by one.
    """
    keys = list(order_by)
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    names = list(header_row) if header_row is not None else df.columns
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} header texts for {len(df.columns)} columns")
    if bom and header:
        names = ["\ufeff" + names[0], *names[1:]]
    df.toDF(*names).write.mode("overwrite").options(**CSV_QUOTES).option("header", header).csv(path, compression=compression)


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read a written dataset back.

    CSV holds no types: give the dataset's ``schema`` (a DDL text or
    StructType) to get them back; without it every column is text, as
    written. Types are never guessed (a month is no timestamp, ``0012`` no
    number).
    """
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.options(**CSV_QUOTES).option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def export_all(datasets: dict[str, Callable[[], DataFrame]], out_dir: str, fmt: str = "parquet") -> list[str]:
    """Write every named dataset under ``out_dir/<name>``.

    The loop runs over dataset definitions on the driver (a few dozen
    names); each write is a distributed job.
    """
    written = []
    for name, build in datasets.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        write_dataset(build(), path, fmt)
        written.append(path)
    return written


def row_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset with its number of rows, as one DataFrame.

    Each dataset contributes a one-row ``count`` aggregate; the union of
    those rows is the result (no data moves to the driver).
    """
    parts = [df.agg(F.count(F.lit(1)).alias("Num_Rows")).select(F.lit(name).alias("Dataset"), "Num_Rows")
             for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, parts)
