"""Nearest neighbours by a block matrix join on quantised vectors.

Vectors are quantised to int8, each with a step of its own, so that an
outlier widens its own bounds only. The product of a
tile of queries with a tile of candidates, on the int8 numbers, gives the
distance of the quantised vectors; by the triangle inequality the true
distance is within the sum of the two quantisation errors. Pairs whose lower
bound is above the query's ``k``-th best upper bound (or the ``k``-th
distance already in its heap) are out; surviving pairs are recomputed on the
original vectors, in double precision, and merged into the query's heap.
The bounds are sure, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame

from loyalframe.llm.common import materialize
from loyalframe.llm.grid import search, usable_vectors

_TILE = 4096


#: Squares of larger components may overflow: bounds are not used then, all pairs are computed.
_SAFE = 1e150


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 matrix, each row's step and each row's quantisation error (Euclidean)."""
    step = np.abs(x).max(1, initial=0.0) / 127
    step[step == 0] = 1.0
    cells = np.rint(x / step[:, None]).astype(np.int8)
    error = np.sqrt(((x - cells * step[:, None]) ** 2).sum(1))
    return cells, step, error


def best_by_tiles(k: int):
    """Search of one block of queries in one block of candidates; see ``grid.search``."""

    def best(queries, candidates):
        with np.errstate(over="ignore", invalid="ignore"):
            return of_blocks(queries, candidates)

    def of_blocks(queries, candidates):
        (qid, q), (cid, c) = queries, candidates
        bounded = max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0)) < _SAFE
        q8, q_step, q_err = quantise(q)
        c8, c_step, c_err = quantise(c)
        # products of int8 numbers are whole; in float32 they are exact up to 2**24, else float64 is taken
        kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        heaps = [[] for _ in qid]  # the k nearest so far, farthest on top: (-distance, -vec_id, row)
        square = lambda m: (m.astype(np.float64) ** 2).sum(1)
        q_len, c_len = square(q8) * q_step ** 2, square(c8) * c_step ** 2
        for qs in range(0, len(q), 256):
            left = q8[qs:qs + 256].astype(kind)
            for cs in range(0, len(c), _TILE):
                cut = slice(cs, cs + _TILE)
                dot = (left @ c8[cut].astype(kind).T).astype(np.float64) * (q_step[qs:qs + 256, None] * c_step[None, cut])
                apart = np.sqrt(np.maximum(q_len[qs:qs + 256, None] + c_len[None, cut] - 2 * dot, 0))
                off = q_err[qs:qs + 256, None] + c_err[None, cut]
                # squared distances are rounded at about 1e-15 of the squared lengths
                off = off + 1e-7 * np.sqrt(q_len[qs:qs + 256, None] + c_len[None, cut])
                if not bounded:
                    apart[:], off[:] = 0.0, np.inf
                apart_max = apart + off
                own = qid[qs:qs + 256, None] == cid[None, cut]
                apart_max[own] = np.inf
                need = min(k, apart.shape[1])
                limit = np.partition(apart_max, need - 1, axis=1)[:, need - 1]
                for i in range(len(left)):
                    heap = heaps[qs + i]
                    most = min(limit[i], -heap[0][0]) if len(heap) == k else limit[i]
                    near = np.flatnonzero((apart[i] - off[i] <= most) & ~own[i])
                    if not len(near):
                        continue
                    diff = c[cs + near] - q[qs + i]
                    exact = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])  # summed in order, as SQL engines do
                    for j, d in zip((cs + near).tolist(), exact.tolist()):
                        item = (-d, -int(cid[j]), j)
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
        out = [(i, j, -d) for i, heap in enumerate(heaps) for d, _, j in heap]
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, j, s = zip(*out)
        return np.array(i), np.array(j), np.array(s)

    return best


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, query_block: int = 2048,
            candidate_block: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score`` (double): Euclidean distance, nearest first.

    Ties go to the smaller vec_id. A query's own row is no candidate of its;
    with fewer than ``k`` others all are returned. Vectors that are null,
    empty, zero or hold a null, NaN or infinity take no part, nor do rows
    without vec_id; vectors of different lengths are not compared. Rows equal
    in vec_id and vector count once; different vectors under one vec_id share
    one list of results as queries, are
    candidates of their own, but not of each other. A distance too large for
    a double is infinite. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = materialize(usable_vectors(vectors, zero_ok=False), "vectors")
    return search(rows, is_query, k, best_by_tiles(k), "double", False, query_block, candidate_block)
