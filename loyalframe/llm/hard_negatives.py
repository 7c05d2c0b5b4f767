"""Hard negatives for contrastive training, scored by the Four-Russians method.

Vectors are whole numbers, floor(``scale`` * x). The index holds each row's
bit planes: plane ``p`` is bit ``p`` (two's complement) of every component,
packed so that one byte covers a group of eight dimensions. For an anchor,
the 256 subset sums of each group's eight components are tabled once; the
sum of an anchor's components over the set bits of a plane is then one
lookup per group, and the exact inner product is a shift and an addition per
plane, the sign plane counting negative. No product is ever taken.

Two searches share that scoring: candidates of the anchor's label give its
positives, candidates of other labels give each positive's negatives. So a
pair of rows is scored about once. Both deal anchors and candidates into
blocks of bounded size by a hash; one task scores one block of anchors
against one block of candidates and returns its few best, and a window keeps
the best of those. Only packed planes of the candidates travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, python_workers, slices

GROUP = 8  # dimensions of one table, bits of one byte
_TILE = 64  # anchors scored at once: 64 x 16384 scores of 8 bytes are 8 MB


def pack_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of the bit planes of whole numbers ``v`` (rows, dimensions)."""
    bits = (v[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """(groups, 256, anchors): for each group of dimensions the sums of all subsets of its components."""
    n, dim = anchors.shape
    groups = -(-dim // GROUP)
    padded = np.zeros((n, groups * GROUP), kind)
    padded[:, :dim] = anchors
    tables = np.zeros((groups, 1 << GROUP, n), kind)
    for g in range(groups):
        for b in range(GROUP):
            tables[g, 1 << b:2 << b] = tables[g, :1 << b] + padded[:, g * GROUP + b]
    return tables


def scores_of(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) exact inner products, by lookups, shifts and additions."""
    count = planes.shape[1]
    most = int(np.abs(anchors).sum(1).max(initial=0)) << count
    kind = np.int32 if most < 1 << 31 else np.int64  # no partial sum is larger
    tables = subset_sums(anchors, kind)
    total = np.zeros((len(planes), len(anchors)), kind)
    part = np.empty_like(total)
    for p in range(count - 1, -1, -1):
        total <<= 1
        for g in range(len(tables)):
            np.take(tables[g], planes[:, p, g], axis=0, out=part)
            if p == count - 1:
                total -= part
            else:
                total += part
    return total


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` highest scores, best first; of equal scores the first rows."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at].astype(np.int64)))]


def _frame(parts: list, names: tuple) -> pd.DataFrame:
    columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*parts) if parts else [[] for _ in names])]
    return pd.DataFrame({n: c.astype(np.int64) for n, c in zip(names, columns)})


def _candidates(right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and planes of a block, in order of id, so that ties go to the first row."""
    right = right.sort_values("vec_id", kind="stable")
    shape = len(right), int(right["planes"].iat[0]), -1
    packed = np.frombuffer(b"".join(right["packed"]), np.uint8).reshape(shape)
    return right["vec_id"].to_numpy(np.int64), right["label"].to_numpy(np.int64), packed


def positives_of(k: int) -> Callable:
    """One cell of the first search: each anchor's ``k`` best other rows of its label."""
    names = ("anchor_id", "key", "vec_id", "score")

    def cell(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            ids, labels, planes = _candidates(right)
            for label, anchors in left.groupby("label", sort=False):
                mine = np.flatnonzero(labels == label)
                for at in range(0, len(anchors) if len(mine) else 0, _TILE):
                    tile = anchors.iloc[at:at + _TILE]
                    got = scores_of(np.stack(tile["v"].to_numpy()).astype(np.int64), planes[mine]).T
                    for own, key, row in zip(tile["vec_id"], tile["key"], got):
                        others = np.flatnonzero(ids[mine] != own)
                        best = others[_best(row[others], k)]
                        parts.append((np.full(len(best), own), np.full(len(best), key), ids[mine][best], row[best]))
        return _frame(parts, names)

    return cell


def negatives_of(k: int, low: int, high: int) -> Callable:
    """One cell of the second search: per positive the ``k`` best rows of other labels within the band."""
    names = ("anchor_id", "key", "place", "vec_id", "score")

    def cell(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            ids, labels, planes = _candidates(right)
            for at in range(0, len(left), _TILE):
                tile = left.iloc[at:at + _TILE]
                got = scores_of(np.stack(tile["v"].to_numpy()).astype(np.int64), planes).T
                for own, key, label, marks, row in zip(tile["vec_id"], tile["key"], tile["label"], tile["marks"], got):
                    marks = np.asarray(marks, np.int64)
                    # a band holds the scores s with low * mark <= 100 * s <= high * mark
                    least, most = -(-low * marks // 100), high * marks // 100
                    near = np.flatnonzero((row >= least.min()) & (row <= most.max()) & (labels != label) & (ids != own))
                    for place in range(len(marks)):
                        fits = near[(row[near] >= least[place]) & (row[near] <= most[place])]
                        best = fits[_best(row[fits], k)]
                        parts.append((np.full(len(best), own), np.full(len(best), key), np.full(len(best), place),
                                      ids[best], row[best]))
        return _frame(parts, names)

    return cell


def plane_index(rows: DataFrame, is_anchor: Column, planes: int) -> DataFrame:
    """``vec_id, label, dim, key, planes, packed`` of (vec_id, label, v); ``v`` stays for anchors only."""
    python_workers(rows.sparkSession)
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.size("v").alias("dim"),
                       F.xxhash64("label", "v").alias("key"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            made = [pack_planes(np.asarray([v], np.int64), planes)[0].tobytes() for v in batch.column("v").to_pylist()]
            flat = [v if a else None for a, v in zip(batch.column("anchor").to_pylist(), batch.column("v").to_pylist())]
            kept = batch.drop_columns(["v"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([planes] * len(made), pa.int32()), pa.array(made, pa.binary()),
                 pa.array(flat, pa.list_(pa.int64()))], names=[*kept.schema.names, "planes", "packed", "v"])

    return rows.mapInArrow(pack, "vec_id long, label long, dim int, key long, anchor boolean, planes int, packed binary, v array<long>")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256,
                   low: int = 50, high: int = 95, vector: str = "embedding", anchor_block: int = 2048,
                   candidate_block: int = 16384) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (rank int, else long).

    ``vectors``: vec_id, label and ``vector``. An anchor's positives are its
    ``positives`` best other rows of the same label (all, if fewer). For each
    of them the best ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``
    are returned, ranked from 1; a positive without such rows gives none.
    Higher scores come first, ties go to the smaller vec_id.

    Rows with a null label, id or vector, an empty vector, or a null, NaN or
    infinite component take no part. Rows equal in id, label and vector count
    once; different rows under one id are candidates of their own, never
    of each other, and as anchors have lists of their own. Vectors of
    different lengths are not compared. Scores are 64-bit integers:
    components must stay below about 2**20 in size. An empty table gives an
    empty result. Extra columns are ignored.
    """
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = materialize(vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v")).distinct(), "whole")
    least, most, n, n_anchors = rows.agg(
        F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    planes = max((most or 0).bit_length(), (-(least or 0) - 1).bit_length() if (least or 0) < 0 else 0) + 1
    index = materialize(plane_index(rows, is_anchor, planes), "planes")
    c_blocks, a_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_anchors / anchor_block))
    h = F.xxhash64("vec_id", "key")

    def side(df: DataFrame, blocks: int, others: int, name: str, other: str) -> DataFrame:
        return df.withColumn(name, F.pmod(h, F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def search(anchors: DataFrame, cell: Callable, result: str) -> DataFrame:
        left = side(anchors, a_blocks, c_blocks, "ab", "cb")
        right = side(index.select("vec_id", "label", "dim", "key", "planes", "packed"), c_blocks, a_blocks, "cb", "ab")
        return left.groupBy("dim", "ab", "cb").cogroup(right.groupBy("dim", "ab", "cb")).applyInPandas(cell, result)

    def ranked(df: DataFrame, keys: tuple, k: int) -> DataFrame:
        best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))
        return df.withColumn("rank", best).where(F.col("rank") <= k)

    anchors = index.where("anchor").select("vec_id", "label", "dim", "key", "v")
    found = search(anchors, positives_of(positives), "anchor_id long, key long, vec_id long, score long")
    found = materialize(ranked(found, ("anchor_id", "key"), positives), "positives")
    # at most ``positives`` marks per anchor; place p of the list is rank p + 1
    marks = found.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("marks"))
    marked = materialize(anchors.join(marks, ["vec_id", "key"]), "marked")
    met = search(marked, negatives_of(negatives, low, high),
                 "anchor_id long, key long, place long, vec_id long, score long")
    met = ranked(met, ("anchor_id", "key", "place"), negatives).withColumnRenamed("score", "negative_score")
    known = found.select("anchor_id", "key", (F.col("rank") - 1).cast("long").alias("place"),
                         F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return met.join(known, ["anchor_id", "key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", "negative_score")
