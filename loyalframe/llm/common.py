"""Helpers shared by the operators: the shared folder, written tables, worker path."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from loyalframe.session import ensure_checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def python_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started elsewhere; bound their batches by bytes."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    if spark.conf.get(_BATCH_BYTES, None) is None:  # a batch of 10,000 long texts would be held several times
        spark.conf.set(_BATCH_BYTES, str(8 << 20))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never the
    steps before. The planner then knows the table's real size, so a join
    with it is broadcast only below ``autoBroadcastJoinThreshold``. Shuffle
    files of the write are no longer needed once it is done; Spark is told
    to remove them then, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(c: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(c), F.lit(""))



def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few results at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_text_columns(df: DataFrame, ddl: str, make: Callable[[], Callable[[list], tuple]], again: str | None = None) -> DataFrame:
    """``df`` with column ``_text`` replaced by the columns of ``ddl``, made from the texts in Arrow batches.

    ``make()`` runs once per task and returns a function from a batch's texts
    (None for null) to one list per new column. Other columns pass through as
    they are, nulls and large numbers included. ``again`` returns the text
    itself under that name, without sending it twice.
    """
    python_workers(df.sparkSession)
    new = StructType.fromDDL(ddl)
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_of = make()
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            rest = batch.drop_columns(["_text"])
            made = [pa.array(values, type=t) for values, t in zip(columns_of(texts), types)]
            own = [batch.column("_text")] if again else []
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, *own, *made], names=[*rest.schema.names, *([again] if again else []), *new.names])

    kept = [f for f in df.schema.fields if f.name != "_text"]
    own = [StructField(again, df.schema["_text"].dataType)] if again else []
    return df.mapInArrow(run, StructType([*kept, *own, *new.fields]))


def slim(docs: DataFrame, keep: tuple = (), *more) -> DataFrame:
    """``doc_id``, ``_text``, further expressions, and the columns of ``keep`` under names that clash with none."""
    return docs.select("doc_id", F.col("text").alias("_text"), *more, *[F.col(c).alias(f"_keep_{c}") for c in keep])


def unkept(keep: tuple) -> list:
    return [F.col(f"_keep_{c}").alias(c) for c in keep]
