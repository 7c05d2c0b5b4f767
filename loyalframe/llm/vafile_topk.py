"""Exact top-k search with a vector-approximation file.

Vectors are integers, floor(``scale`` * x). The approximation file holds one
byte per component, the number of its cell, and each row's lowest component
and cell width; it is written once. A search scans approximations only: a
task gets a block of queries with a block of cells, and one product bounds
each inner product from both sides, in whole numbers. Candidates that ``k``
others of the block surely precede are out; what is left is held against the
``k``-th lower bound of all blocks. Exact vectors are then read, by a join,
in order of the upper bound: first ``2 * k`` per query, then those whose
bound is not below the ``k``-th exact score, which is certain from then on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, python_workers
from loyalframe.llm.grid import usable_vectors

_CHUNK = 64  # queries scanned at once: 64 x 16384 bounds are 8 MB
_CELLS = 256  # as many as a byte can tell


def approximate(v: np.ndarray, bits: int = 8) -> tuple[int, int, bytes]:
    """(lowest component, cell width, cell numbers): a component is low + cell * width + 0 .. width - 1."""
    low = int(v.min())
    width = (int(v.max()) - low) // (1 << bits) + 1
    return low, width, ((v - low) // width).astype(np.uint8).tobytes()


def scan_cells(k: int, q: np.ndarray, qid: np.ndarray, cid: np.ndarray, low: np.ndarray, width: np.ndarray,
               cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, lower, upper) of the pairs that may be among a query's ``k`` best of this block.

    A pair is out if ``k`` candidates have a lower bound above its upper
    bound, or equal to it with a smaller id.
    """
    # sums of products are whole numbers, exact in float64 below 2**53
    kind = np.float64 if q.shape[1] * int(np.abs(q).max(initial=0)) * _CELLS < 1 << 53 else np.int64
    columns = cells.astype(kind).T
    out = [[], [], [], []]
    for at in range(0, len(q), _CHUNK):
        part = q[at:at + _CHUNK]
        base = low * part.sum(1, keepdims=True) + width * (part.astype(kind) @ columns).astype(np.int64)
        upper = base + (width - 1) * np.maximum(part, 0).sum(1, keepdims=True)
        lower = base - (width - 1) * np.maximum(-part, 0).sum(1, keepdims=True)
        for i in range(len(part)):
            others = np.flatnonzero(cid != qid[at + i])
            below, above, ids = lower[i][others], upper[i][others], cid[others]
            left = np.arange(len(others))
            if len(others) > k:
                sure = np.partition(below, len(below) - k)[len(below) - k]
                tied = ids[below == sure]
                place = k - int((below > sure).sum()) - 1
                last = np.partition(tied, place)[place]
                left = np.flatnonzero((above > sure) | (above == sure) & (ids <= last))
            for o, x in zip(out, (np.full(len(left), at + i), others[left], below[left], above[left])):
                o.append(x)
    return tuple(np.concatenate(o) for o in out)


def _approximation_file(rows: DataFrame, bits: int) -> DataFrame:
    """``row, vec_id, dim, low, width, cells`` of ``rows`` (row, vec_id, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [approximate(np.asarray(v, np.int64), bits) for v in pdf["v"]]
            low, width, cells = map(list, zip(*made)) if made else ([], [], [])
            yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "dim": [len(c) for c in cells],
                                "low": low, "width": width, "cells": cells})

    python_workers(rows.sparkSession)
    return rows.mapInPandas(run, "row long, vec_id long, dim int, low long, width long, cells binary")


def _bounds(queries: DataFrame, cells: DataFrame, k: int, query_block: int, candidate_block: int) -> DataFrame:
    """``query_id, q, c, vec_id, lower, upper`` of the pairs left by the scan of all blocks; q and c are row numbers."""
    def blocks(df: DataFrame, size: int) -> int:
        return max(1, math.ceil(df.count() / size))

    qs, cs = blocks(queries, query_block), blocks(cells, candidate_block)

    def side(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def scan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "q", "c", "vec_id", "lower", "upper"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in names})
        cid, matrix = right["vec_id"].to_numpy(np.int64), np.frombuffer(b"".join(right["cells"]), np.uint8)
        qid = left["vec_id"].to_numpy(np.int64)
        i, j, lower, upper = scan_cells(k, np.stack(left["v"].to_numpy()).astype(np.int64), qid, cid,
                                        right["low"].to_numpy(np.int64), right["width"].to_numpy(np.int64),
                                        matrix.reshape(len(cid), -1))
        rows = left["row"].to_numpy(np.int64)[i], right["row"].to_numpy(np.int64)[j]
        return pd.DataFrame(dict(zip(names, (qid[i], *rows, cid[j], lower, upper))))

    a = side(queries.select(F.size("v").alias("dim"), "row", "vec_id", "v"), "qb", qs, "cb", cs)
    b = side(cells, "cb", cs, "qb", qs)
    keys = ["dim", "qb", "cb"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(
        scan, "query_id long, q long, c long, vec_id long, lower long, upper long")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, bits: int = 8,
                query_block: int = 512, candidate_block: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score`` (long): highest integer inner products first.

    Ties go to the smaller vec_id, so that of rows with equal vectors only
    the ``k + 1`` smallest ids can be a result (one may be the query's own):
    only they are in the approximation file; all are queries. A query's own
    row is no candidate of its; with fewer than ``k`` others all are
    returned. Vectors that are null,
    empty or hold a null, NaN or infinity take no part, nor do rows without
    vec_id; vectors of different lengths are not compared. Rows equal in
    vec_id and vector count once; different vectors under one vec_id share
    one list of results as queries, are
    candidates of their own, but not of each other. Scores are 64-bit
    integers: components must stay below about 2**28 in size. An empty table
    gives an empty result. Extra columns are ignored. ``bits``, 8 at most,
    sets the number of cells per row, not the result.
    """
    if not 1 <= bits <= 8:
        raise ValueError("a cell number must fit a byte")
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = usable_vectors(vectors, zero_ok=True).select("vec_id", whole.alias("v")).distinct()
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "whole")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    cells = materialize(_approximation_file(
        rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("row", "vec_id", "v"), bits), "cells")
    bounds = materialize(_bounds(rows.where(is_query), cells, k, query_block, candidate_block), "bounds")

    def kth(pairs: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), "vec_id")
        return pairs.select("query_id", "vec_id", by).withColumn("n", F.row_number().over(order)).where(
            F.col("n") == k).select("query_id", F.col(by).alias("sure"), F.col("vec_id").alias("sure_id"))

    possible = F.col("sure").isNull() | (F.col("upper") > F.col("sure")) | (
        (F.col("upper") == F.col("sure")) & (F.col("vec_id") <= F.col("sure_id")))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id", "q", "c"))
    left = bounds.join(kth(bounds, "lower"), "query_id", "left").where(possible).select("query_id", "q", "c", "vec_id", "upper")
    left = materialize(left.withColumn("turn", turn), "left")

    def exact(pairs: DataFrame) -> DataFrame:
        read = pairs.join(rows.select(F.col("row").alias("q"), F.col("v").alias("a")), "q").join(
            rows.select(F.col("row").alias("c"), F.col("v").alias("b")), "c")
        product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return read.select("query_id", "vec_id", product.alias("score"))

    first = materialize(exact(left.where(F.col("turn") <= 2 * k)), "first")
    rest = left.where(F.col("turn") > 2 * k).join(kth(first, "score"), "query_id").where(possible)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = first.unionByName(exact(rest)).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
