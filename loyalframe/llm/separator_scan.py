"""Token counts from flat, unindexed token files.

A flat token file is a sequence of little-endian 16-bit token ids in which
every document ends with the end-of-document id; nothing says where a
document starts. A scan cuts every file into blocks; tasks read the byte
ranges of their blocks only, so that one file is read by many tasks. The
separators of a block are found by one vectorised comparison: documents
that start and end in the block are done, what is cut by its ends are
pieces, two per block at most. Prefix scans over the blocks of a file, as
windows over the pieces and over the number of separators per block, stitch
documents that cross block boundaries, however many, and number them all.

``write_token_files`` makes such files from texts with Spark's text sink:
the separator is the sink's line separator, so that the files are flat,
committed like any Spark output, and of the size of the input's splits.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, python_workers, scratch_path, slices

END = 50256
#: A document may start with its doc_id: 64 bits and a null flag, as five numbers of 15 bits.
HEADER = 5


def _header(doc_id: int | None) -> np.ndarray:
    bits = 1 << 64 if doc_id is None else doc_id & (1 << 64) - 1
    return np.array([bits >> 15 * i & 0x7FFF for i in range(HEADER)], "<u2")


def _doc_ids(header: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc ids, null flags) of an array of headers."""
    h = header.astype(np.uint64)
    low = np.zeros(len(h), np.uint64)
    for i in range(4):
        low |= h[:, i] << np.uint64(15 * i)
    low |= (h[:, 4] & np.uint64(0xF)) << np.uint64(60)
    return low.astype(np.int64), (h[:, 4] >> np.uint64(4)).astype(bool)


_TOKENISERS: dict[tuple, tiktoken.Encoding] = {}


def _tokeniser(file: str, pattern: str) -> tiktoken.Encoding:
    if (file, pattern) not in _TOKENISERS:
        with open(SparkFiles.get(file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOKENISERS[file, pattern] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _TOKENISERS[file, pattern]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, pattern: str, end: int = END) -> None:
    """Write every document of ``docs`` (doc_id, text) as header, token ids and ``end``.

    The vocabulary's ids must be below ``end``, ``end`` below 2**16. A null
    text is the empty text, a null doc_id is kept as null.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    file = vocabulary.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _tokeniser(file, pattern)
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(codec.encode_ordinary(text or ""), dtype="<u2")
                out.append(np.concatenate([_header(doc_id), ids]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    python_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "ids binary")
    separator = end.to_bytes(2, "little").decode("latin-1")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).option(
        "encoding", "ISO-8859-1").option("compression", "none").text(path)


def read_range(path: str, offset: int, size: int) -> bytes:
    """``size`` bytes of a file at ``offset``; ``path`` as Spark lists it, on a mounted or an object store."""
    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), path.removeprefix("file:")
    else:
        store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    with store.open_input_file(name) as f:
        return f.read_at(size, offset)


def block_pieces(ids: np.ndarray, first: bool, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, starts, ends) of the documents and pieces of one block, in order.

    ``starts``: begins in this block, or the block is the ``first`` of its
    file; ``ends``: closed by a separator of this block. The last piece is
    what follows the last separator, of any length, also 0.
    """
    found = np.flatnonzero(ids == end)
    start = np.concatenate([[0], found + 1])
    length = np.concatenate([found, [len(ids)]]) - start
    starts, ends = np.ones(len(start), bool), np.ones(len(start), bool)
    starts[0], ends[-1] = first, False
    return start, length, starts, ends


_PIECES = ("path string, block long, place long, starts boolean, ends boolean, length long, "
           "doc_id long, head array<int>")


def _headed(doc_ids: np.ndarray, null: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(doc_ids.astype(np.int64), null.astype(bool))


def _pieces(files: DataFrame, end: int, block: int, with_header: bool, task_bytes: int) -> DataFrame:
    """The documents and pieces of every block of ``files`` (path, length)."""
    spark = files.sparkSession
    step = 2 * block
    total, blocks = files.agg(F.sum("length"), F.sum(F.ceil(F.col("length") / F.lit(step)))).first()
    tasks = max(1, math.ceil((total or 0) / task_bytes), min(blocks or 0, 4 * spark.sparkContext.defaultParallelism))
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block")).repartition(tasks, "path", "block")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, number in zip(pdf["path"], pdf["length"], pdf["block"]):
                if size % 2:
                    raise ValueError(f"{path} is not a file of 16-bit token ids")
                ids = np.frombuffer(read_range(path, int(number) * step, min(step, int(size - number * step))), "<u2")
                start, length, starts, ends = block_pieces(ids, number == 0, end)
                whole = starts & ends
                doc, null = np.zeros(len(start), np.int64), np.ones(len(start), bool)
                known = whole & (length >= HEADER) & with_header
                if known.any():
                    doc[known], null[known] = _doc_ids(ids[start[known][:, None] + np.arange(HEADER)])
                heads = np.empty(len(start), object)
                for i in np.flatnonzero(~whole):  # at most the first and the last
                    heads[i] = ids[start[i]:start[i] + min(length[i], HEADER)].astype(np.int32)
                yield pd.DataFrame({
                    "path": path, "block": number, "place": np.arange(len(start)), "starts": starts, "ends": ends,
                    "length": length, "doc_id": _headed(doc, null), "head": heads})

    return ranges.mapInPandas(scan, _PIECES)


def _stitched(pieces: DataFrame, with_header: bool) -> DataFrame:
    """Documents of several pieces: ``path, block, place, ends, length, doc_id``; block and place are of the last piece."""
    order = Window.partitionBy("path").orderBy("block", "place")
    numbered = pieces.withColumn("doc", F.sum(F.col("starts").cast("long")).over(order))
    before = Window.partitionBy("path", "doc").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # only the pieces that hold ids of the header: at most as many as the header is long, and empty ones
    head = F.when((F.col("before") < HEADER) & (F.col("length") > 0), F.struct("block", "place", "head"))
    docs = numbered.groupBy("path", "doc").agg(
        F.max(F.struct("block", "place", "ends")).alias("last"), F.sum("length").alias("length"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(head)), lambda h: h["head"])), 1, HEADER).alias("head"))
    docs = docs.where(F.col("last.ends") | (F.col("length") > 0)).select("path", "last.*", "length", "head")
    h = [F.element_at("head", i + 1).cast("long") for i in range(HEADER)]
    low = h[0]
    for i in range(1, HEADER):
        low = low.bitwiseOR(F.shiftleft(h[i] if i < 4 else h[i].bitwiseAND(F.lit(0xF)), 15 * i))
    named = F.when((F.size("head") == HEADER) & F.lit(with_header) & (F.shiftright(h[4], 4) == 0), low)
    return docs.withColumn("doc_id", named).drop("head")


def scan_token_files(spark: SparkSession, path: str, end: int = END, block: int = 1 << 20,
                     with_header: bool = True, task_bytes: int = 128 << 20) -> DataFrame:
    """``doc_id, n_tokens, file, ordinal, closed`` of every document of the files below ``path``.

    ``file`` is the file's name, ``ordinal`` the document's place in it.
    Documents do not cross files; ids after a file's last separator are a
    document that is not ``closed``. An empty document counts 0. Without
    headers, or for an unfinished document that ends within its header,
    ``doc_id`` is null. An empty folder gives an empty result. A file may have
    any size: a task reads blocks of ``block`` ids, one at a time, of any
    files, about ``task_bytes`` in all. Blocks are opened by their path, on a
    mounted store or one that Arrow's file systems reach. A file of an odd
    number of bytes is an error.
    """
    python_workers(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lists the files, reads none
    pieces = materialize(_pieces(files, end, block, with_header, task_bytes), "pieces")
    counts = pieces.groupBy("path", "block").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    names = ["path", "block", "place", "ends", "length", "doc_id"]
    docs = pieces.where("starts AND ends").select(*names).unionByName(
        _stitched(pieces.where("NOT (starts AND ends)"), with_header).select(*names))
    size = F.greatest(F.col("length") - HEADER, F.lit(0)) if with_header else F.col("length")
    return docs.join(offsets, ["path", "block"]).select(
        "doc_id", size.cast("long").alias("n_tokens"), F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("offset") + F.col("place")).alias("ordinal"), F.col("ends").alias("closed"))


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, end: int = END, block: int = 1 << 20) -> DataFrame:
    """Write ``docs`` as flat token files in the shared folder and count each document's tokens there.

    One row per row of ``docs`` (repeated rows too): doc_id, n_tokens, file,
    ordinal, closed. Extra columns are ignored; an empty table gives none.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, pattern, end)
    return scan_token_files(docs.sparkSession, path, end, block)
