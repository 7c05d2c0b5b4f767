"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

The vocabulary is counted by Spark. Its words go into blocked Bloom filters,
one per word length (256-bit blocks, one bit in each of eight lanes), built
by a ``bit_or`` per block and broadcast. Each word's edits, all deletions of
one letter (probed against the next shorter length) and all replacements by
a later letter (same length), are probed there; an insertion is another
word's deletion, so every pair is met once. Hashes add up a mixed value per
(position, letter), so the hash of an edit follows from the word's by a
subtraction and an addition, without making its text.

Only edits that a filter lets through are shuffled, as pairs of hashes, to
an exact join with the vocabulary; the texts of the pairs it leaves are
compared, so filters and hashes lose or add nothing. The filters broadcast
at once are bounded by ``filter_bytes``: a larger vocabulary is dealt into
slices by hash, filtered and probed one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, python_workers, slices, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z; each letter is one byte in Latin-1
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
_BLOCK = 256  # bits
_CELLS = 1 << 18  # edits probed at once


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def value(position: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix((position.astype(np.uint64) << np.uint64(8)) | letter.astype(np.uint64))


def word_hashes(words: list) -> np.ndarray:
    """Sum of the values of each word's letters; words are not empty."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    return np.add.reduceat(value(np.arange(len(flat)) - np.repeat(starts, lengths), flat), starts)


def block_masks(h: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, list]:
    """Block number and the four 64-bit masks (two lanes each) of hashes."""
    low = h & np.uint64(0xFFFFFFFF)
    block = ((h >> np.uint64(32)) * blocks) >> np.uint64(32)
    masks = []
    for j in range(0, 8, 2):
        a, b = (((low * _LANES[j + i]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27) for i in (0, 1))
        masks.append((np.uint64(1) << a) | (np.uint64(1) << (b + np.uint64(32))))
    return block.astype(np.int64), masks


def slice_of(h: np.ndarray, count: int) -> np.ndarray:
    return mix(h) % np.uint64(count)


class Filters:
    """Blocked Bloom filters by word length: ``tables[length]`` is (blocks, 4) 64-bit numbers."""

    def __init__(self, tables: dict, part: int, parts: int):
        self.tables, self.part, self.parts = tables, part, parts

    def may_hold(self, h: np.ndarray, length: int) -> np.ndarray:
        """Positions of the hashes that the filter of ``length`` lets through."""
        rows = self.tables.get(length)
        if rows is None:
            return np.empty(0, np.int64)
        at = np.arange(len(h)) if self.parts == 1 else np.flatnonzero(slice_of(h, self.parts) == self.part)
        block, masks = block_masks(h[at], np.uint64(len(rows)))
        for j in range(4):
            hit = np.flatnonzero((rows[block, j] & masks[j]) == masks[j])
            at, block, masks = at[hit], block[hit], [m[hit] for m in masks]
        return at


def edits_of(words: list, letters: np.ndarray, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """(word's hash, edit's hash) of the edits of equally long ``words`` that the filters let through."""
    length = len(words[0])
    w = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    here = value(np.arange(length)[None, :], w)
    before = np.cumsum(here, axis=1, dtype=np.uint64) - here
    whole = here.sum(axis=1, dtype=np.uint64)
    moved = value(np.maximum(np.arange(length) - 1, 0)[None, :], w)
    after = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
    own, found = [], []
    # the same letter twice in a row: leaving out either gives the same word
    first = np.ones(w.shape, bool)
    first[:, 1:] = w[:, 1:] != w[:, :-1]
    row, _ = np.nonzero(first)
    h = (before + after)[first]
    for at in range(0, len(h), _CELLS):
        hit = at + filters.may_hold(h[at:at + _CELLS], length - 1)
        own.append(whole[row[hit]])
        found.append(h[hit])
    if length in filters.tables:
        step = max(1, _CELLS // (len(words) * len(letters)))
        for at in range(0, length, step):
            cut = slice(at, at + step)
            new = value(np.arange(length)[cut, None], letters[None, :])
            rest = whole[:, None] - here[:, cut]
            row, place, letter = np.nonzero(letters[None, None, :] > w[:, cut, None])
            h = rest[row, place] + new[place, letter]
            hit = filters.may_hold(h, length)
            own.append(whole[row[hit]])
            found.append(h[hit])
    return np.concatenate(own), np.concatenate(found)


def count_words(docs: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """``word, n`` of the corpus, the rows of every 31st (by checksum) losing one letter."""
    runs = F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    df = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    df = df.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    gap = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring(F.col("run"), gap + 2, F.length("run")))
    df = df.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return df.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def hashed(words: DataFrame) -> DataFrame:
    """Add ``h`` (the word's hash) and ``len``."""
    python_workers(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            texts = batch.column("word").to_pylist()
            h = word_hashes(texts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(h), pa.array(list(map(len, texts)), pa.int32())], names=[*batch.schema.names, "h", "len"])

    return words.mapInArrow(run, "word string, n long, h long, len int")


def build_filters(vocabulary: DataFrame, blocks: dict, part: int, parts: int) -> Filters:
    """The filters of one slice of the vocabulary; ``blocks`` gives each length's number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            lengths = batch.column("len").to_numpy()
            if parts > 1:
                kept = slice_of(h, parts) == part
                h, lengths = h[kept], lengths[kept]
            block, masks = block_masks(h, np.array([blocks[x] for x in lengths.tolist()], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths), pa.array(block), *[pa.array(m.view(np.int64)) for m in masks]],
                names=["len", "block", "m0", "m1", "m2", "m3"])

    marks = vocabulary.select("h", "len").mapInArrow(run, "len int, block long, m0 long, m1 long, m2 long, m3 long")
    marks = marks.groupBy("len", "block").agg(*[F.bit_or(f"m{j}").alias(f"m{j}") for j in range(4)])
    tables = {n: np.zeros((count, 4), np.uint64) for n, count in blocks.items()}
    got = marks.toArrow()  # at most ``filter_bytes`` of blocks
    lengths, block = got.column("len").to_numpy(), got.column("block").to_numpy()
    rows = np.stack([got.column(f"m{j}").to_numpy() for j in range(4)], axis=1).view(np.uint64)
    for n in tables:
        of = lengths == n
        tables[n][block[of]] = rows[of]
    return Filters(tables, part, parts)


def probe(vocabulary: DataFrame, letters: str, filters: Filters) -> DataFrame:
    """``a, b``: hashes of a word and of one of its edits that passed the filters."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)
    alphabet = np.frombuffer(letters.encode("latin-1"), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, 4096):
            groups: dict[int, list] = {}
            for word in batch.column("word").to_pylist():
                groups.setdefault(len(word), []).append(word)
            for length, words in groups.items():
                step = max(1, _CELLS // length)
                for at in range(0, len(words), step):
                    a, b = edits_of(words[at:at + step], alphabet, held)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    # many edits per word: spread the words over all tasks, a small table would be read by a few
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vocabulary.select("word").repartition(tasks, "word").mapInArrow(run, "a long, b long")


def near_pairs(vocabulary: DataFrame, bits: int = 12, filter_bytes: int = 16 << 20) -> DataFrame:
    """``a, n_a, b, n_b``: every two words of (word, n, h, len) one edit apart, each pair once."""
    counts = {r["len"]: r["n"] for r in vocabulary.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    letters = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect()))  # 90 at most
    parts = max(1, math.ceil(sum(counts.values()) * bits / 8 / filter_bytes))
    blocks = {n: math.ceil(c / parts * bits / _BLOCK) + 1 for n, c in counts.items()}
    found = None
    for part in range(parts):
        passed = materialize(probe(vocabulary, letters, build_filters(vocabulary, blocks, part, parts)), "passed")
        found = passed if found is None else found.unionByName(passed)
    # exact join: the edit's hash is that of a word, then both words' texts are compared
    b = vocabulary.select(F.col("h").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    a = vocabulary.select(F.col("h").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    pairs = found.join(b, "b").select("a", "b", "word_b", "n_b").distinct().join(a, "a")
    return pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select(
        F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of (word, form): the end of each word's chain of forms, by doubling.

    A form's count is at least ten times its word's, so chains never close
    and are at most 19 long.
    """
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        links = materialize(links, "links")
        after = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = links.join(after, "root", "left")
        if links.where("_next IS NOT NULL").isEmpty():
            return links.select("word", "root")
        links = links.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10,
                      bits: int = 12, filter_bytes: int = 16 << 20) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of the corpus.

    Words are maximal runs of Latin letters, A-Z lower-cased, of at least
    ``min_length`` letters and ``min_count`` occurrences; of the runs whose
    checksum with their doc_id (null: empty) is a multiple of 31, one letter
    is left out, as a simulated misspelling. Two words are near when one
    inserted, deleted or replaced letter makes them equal. A word's form is
    its near word of largest n, ties to the first in code-point order, if
    that is at least ``ratio`` times the word's own n, else null; its root is
    the last of the chain of forms, itself without one.

    Null, empty and letterless texts have no words; texts of any length are
    taken whole; repeated rows count each. An empty table gives an empty
    result. Extra columns are ignored.
    """
    words = materialize(hashed(count_words(docs, min_length, min_count)), "words")
    pairs = near_pairs(words, bits, filter_bytes)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))))
        .alias("p")).select("p.*")
    common = F.when(F.col("other_n") >= ratio * F.col("n"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(common).alias("f"))
    near = materialize(near.select("word", "n_near", F.col("f.w").alias("form"), (-F.col("f.n")).alias("form_n")), "near")
    ends = roots(near.where("form IS NOT NULL"))
    known = near.join(ends, "word", "left")
    return words.select("word", "n").join(known, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
