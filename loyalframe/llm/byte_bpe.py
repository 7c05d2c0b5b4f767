"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions. For each merge rank there is
a bucket of the positions whose pair has that rank, and a two-level bitmap
of the ranks with entries: find-first-set on its summary, then on one word,
gives the lowest rank without a heap over all pairs. A position is checked
when taken and skipped if its pair has changed since. Equal ranks are taken
from left to right. Each merge costs a bounded number of steps, so a
pre-token of any length takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from loyalframe.llm.common import slim, unkept, with_text_columns

#: Encoded pre-tokens kept in a worker; older ones stay, new ones are then encoded each time.
CACHED = 400_000


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


class BytePairCodec:
    """Encoder and decoder of one vocabulary (token bytes to rank) and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.text = [str(i) for i in range(len(self.tokens))]
        self.single = [ranks[bytes([b])] for b in range(256)]
        # rank of the token that two neighbours make, by both ids
        self.shift = len(self.tokens).bit_length()
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << self.shift | b] = rank
        # the queue: positions by merge rank, and the first level of its bitmap, 256 ranks a word
        self.buckets: list[list] = [[] for _ in self.tokens]
        self.words = [0] * (len(self.tokens) // 256 + 1)
        self.cache: dict[str, tuple] = {}
        self.cached = cached

    def merge(self, piece: bytes) -> tuple:
        """Ids of one pre-token. Buckets and bitmap are the codec's own and empty again at the end."""
        pairs, shift, buckets, words = self.pairs.get, self.shift, self.buckets, self.words
        single = self.single
        ids = [single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the pair that starts at a position, -1: none
        current = [pairs(a << shift | b, -1) for a, b in zip(ids, ids[1:])]
        current.append(-1)
        summary = 0
        for at, rank in enumerate(current):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    words[rank >> 8] |= 1 << (rank & 255)
                    summary |= 1 << (rank >> 8)
                bucket.append(at)  # increasing, so already a heap
        while summary:
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                bits &= bits - 1
                words[word] = bits
                if not bits:
                    summary &= summary - 1
            if current[at] != rank:
                continue  # stale: the pair was merged or has changed
            ids[at] = rank
            gone = after[at]
            follow = after[at] = after[gone]
            current[gone] = -1
            if follow < n:
                before[follow] = at
                new = current[at] = pairs(rank << shift | ids[follow], -1)
                if new >= 0:
                    bucket = buckets[new]
                    if not bucket:
                        words[new >> 8] |= 1 << (new & 255)
                        summary |= 1 << (new >> 8)
                    heappush(bucket, at)
            else:
                current[at] = -1
            prev = before[at]
            if prev >= 0:
                new = current[prev] = pairs(ids[prev] << shift | rank, -1)
                if new >= 0:
                    bucket = buckets[new]
                    if not bucket:
                        words[new >> 8] |= 1 << (new & 255)
                        summary |= 1 << (new >> 8)
                    heappush(bucket, prev)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        cache, ids = self.cache, []
        extend = ids.extend
        for piece in self.split(text):
            found = cache.get(piece)
            if found is None:
                data = piece.encode()
                rank = self.ranks.get(data)
                found = self.merge(data) if rank is None else (rank,)
                if len(cache) < self.cached and len(piece) < 64:
                    cache[piece] = found
            extend(found)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_CODECS: dict[tuple, BytePairCodec] = {}


def worker_codec(file: str, pattern: str) -> BytePairCodec:
    """This worker's codec of a vocabulary file that Spark has sent to it; built once."""
    key = file, pattern
    if key not in _CODECS:
        _CODECS.clear()
        with open(SparkFiles.get(file), "rb") as f:
            _CODECS[key] = BytePairCodec(read_ranks(f.read()), pattern)
    return _CODECS[key]


def tokenise(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False, keep: tuple = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for every row of ``docs``.

    ``vocabulary`` is a file of the driver; Spark sends it to the workers.
    A null text is the empty text: no ids. Whole texts of any length are
    encoded; repeated rows have equal results; an empty table gives an empty
    result; extra columns are ignored unless named in ``keep``.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    file = vocabulary.rsplit("/", 1)[-1]

    def make():
        codec = worker_codec(file, pattern)

        def columns(texts: list) -> tuple:
            counts, digests, decoded, lists = [], [], [], []
            for text in texts:
                ids = codec.encode(text or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join([codec.text[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.array(ids, np.int32))
            return (counts, digests, decoded, lists) if with_ids else (counts, digests, decoded)

        return columns

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return with_text_columns(slim(docs, keep), ddl, make).select("doc_id", *names, *unkept(keep))
