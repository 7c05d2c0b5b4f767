"""Queries against all candidates, in blocks.

A search compares each of its queries with each candidate. The rows of both
sides are dealt into blocks of bounded size by a hash, and one task gets one
block of queries with one block of candidates: (query rows x candidate
blocks + candidate rows x query blocks) are shuffled, and no task or driver
ever holds a whole side. Each task returns its best ``k`` per query; a
window keeps the best of those.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import python_workers

RESULT = "query_id long, vec_id long, score {0}"


def usable_vectors(vectors: DataFrame, zero_ok: bool, vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of the rows with a whole, finite vector; equal rows once."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    if not zero_ok:
        ok = ok & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select("vec_id", v.cast("array<double>").alias("v")).distinct()


def search(rows: DataFrame, is_query: Column, k: int, best: Callable, kind: str, largest: bool,
           query_block: int, candidate_block: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query.

    ``rows``: vec_id, v. ``best(queries, candidates)`` gets (ids, matrix) of
    both and returns arrays (query row, candidate row, score), at least the
    ``k`` best of each query, the query's own id left out.
    """
    spark = rows.sparkSession
    python_workers(spark)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    # vectors of another length cannot be compared; lengths form separate grids of the same shape
    n, q = sizes.agg(F.max("n"), F.max("q")).first()
    n_blocks, q_blocks = max(1, math.ceil((n or 0) / candidate_block)), max(1, math.ceil((q or 0) / query_block))
    h = F.xxhash64("vec_id", "v")

    def side(df: DataFrame, blocks: int, others: int, name: str, other: str) -> DataFrame:
        return df.select(F.size("v").alias("dim"), F.pmod(h, F.lit(blocks)).cast("int").alias(name), "vec_id", "v").withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    queries = side(rows.where(is_query), q_blocks, n_blocks, "qb", "cb")
    candidates = side(rows, n_blocks, q_blocks, "cb", "qb")
    result = RESULT.format(kind)

    def cell(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "int64" if kind == "long" else "float64"})
        ids = left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        i, j, s = best((ids[0], a), (ids[1], b))
        return pd.DataFrame({"query_id": ids[0][i], "vec_id": ids[1][j], "score": s})

    found = queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("dim", "qb", "cb")).applyInPandas(cell, result)
    order = [F.col("score").desc() if largest else F.col("score"), F.col("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
