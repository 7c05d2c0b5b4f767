"""N-gram Jaccard join with a prefix tree.

A document is the set of its word n-grams. Two documents link when the
Jaccard similarity of their sets reaches a threshold; the result is each
document's class under chains of links.

1. Equal sets are one class: copies, however many, cost one row each.
2. Candidates. Sizes fall into ranges, linked sets into the same range or
   the next. All n-grams have one order per range, rare ones first; linked
   sets share an n-gram within their prefixes, the first
   ``n - ceil(t * n) + 1`` n-grams in that order. Document frequencies are
   counted over all classes for the n-grams whose hash falls into a lower
   part of the hash range, a quarter for large sets, more for small ones, so
   that it fills the prefix; these come first in the order, by frequency, the
   others follow by hash. A class whose prefix holds only n-grams of its own
   cannot link and is done. The classes left meet by prefix n-gram and range.
   Each carries the parities of its n-grams in some hundred buckets: two
   sets differ in at least as many n-grams as parities, so that most sets
   with a common n-gram by chance are known not to link. Those that may link
   fall into candidate clusters, so that chance makes no chains of clusters.
3. Prefix tree. The sets of a cluster are stored in a tree of globally
   ordered n-grams, common ones first, so that similar sets share a path and
   their overlap with a new set is counted once. The overlap so far and the
   least and largest sizes below a node bound what can still be reached;
   hopeless subtrees are cut, as are subtrees that are already in the new
   set's class. Every link between different classes so found is a union.
4. A cluster above ``cell_ngrams`` is dealt into cells by a hash: first each
   cell alone, then the leaders of the classes found, and last, for clusters
   still in several classes, each cell with the documents outside the
   cluster's largest class, in chunks. Two documents of different classes
   meet in that last step, so no link is lost, and no task holds more than
   about two cells.

N-grams are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, python_workers, slices, slim, with_text_columns
from loyalframe.llm.components import components

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_TOP = np.uint64(1 << 63)  # turns the order of unsigned numbers into that of signed ones
_PART_TOKENS = 100_000  # prefix n-grams that meet in one task
_PAIRWISE = 16  # sets with a common prefix n-gram that are compared in pairs, all at once


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words are one n-gram, no words the empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(w) - width + 1
    h = np.full(size, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i:i + size]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return np.unique(h ^ (h >> np.uint64(31)))


def signature(ngrams: np.ndarray) -> tuple[int, int]:
    data = ngrams.tobytes()
    return tuple(x - (1 << 64) if x >> 63 else x for x in (
        xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, seed=1)))


class Sizes:
    """Ranges of set sizes: linked sets are in the same one or the next."""

    def __init__(self, percent: int):
        self.percent = percent
        self.width = max(math.log(100 / percent) * 1.000001, 1e-9)  # leaves room for rounding

    def of(self, n: int) -> int:
        return math.floor(math.log(n) / self.width)

    def counted(self, size: int) -> np.uint64:
        """Hashes below are counted: a quarter of all or more, never more than in the range before."""
        n = math.exp(size * self.width)
        share = 1 - self.percent / 100 + 1 / n + 1.75 / math.sqrt(n)  # a prefix and 3.5 deviations
        return np.uint64(min(int(max(share, 0.25) * 2.0 ** 64), (1 << 64) - 1))

    def words(self, size: int) -> int:
        """64-bit words of the parities, a power of two: chance leaves half of them different, links at most a third of that."""
        differ = 2 * (100 - self.percent) / (100 + self.percent) * math.exp((size + 1) * self.width)
        return 1 << min(7, math.ceil(math.log2(max(1, 3.4 * differ / 64))))


def parities(ngrams: np.ndarray, words: int) -> bytes:
    """Of the n-grams in each of 64 * ``words`` buckets; those for half the words are the two halves' XOR."""
    counts = np.bincount((ngrams & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def halved(bits: bytes, words: int) -> bytes:
    x = np.frombuffer(bits, "<u8")
    while len(x) > words:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x.tobytes()


def may_link(node: np.ndarray, n: np.ndarray, own: np.ndarray, bits: np.ndarray, row: np.ndarray, token: np.ndarray,
             percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all sets with a common token that may link, by their sizes and parities.

    ``row, token``: the tokens of each set; ``own``: sets of this range, the
    others are of the range before, where they meet each other.
    """
    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ham = np.bitwise_count(bits[a] ^ bits[b]).sum(-1, dtype=np.int64)
        both, least, most = n[a] + n[b], np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        return (own[a] | own[b]) & (100 * least >= percent * most) & ((100 + percent) * ham <= (100 - percent) * both)

    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])[:len(token)]
    m = np.diff(np.r_[first, len(token)])
    end, small = np.repeat(first + m, m), np.repeat(m <= _PAIRWISE, m)
    at, codes = np.arange(len(token)), [np.empty(0, np.int64)]
    for lag in range(1, _PAIRWISE):
        i = np.flatnonzero(small & (at + lag < end))
        codes.append(np.minimum(row[i], row[i + lag]) * len(node) + np.maximum(row[i], row[i + lag]))
    codes = np.unique(np.concatenate(codes))
    a, b, step = [], [], max(1, (1 << 20) // bits.shape[1])
    for i in range(0, len(codes), step):
        x, y = np.divmod(codes[i:i + step], len(node))
        linked = close(x, y)
        a.append(node[x[linked]])
        b.append(node[y[linked]])
    root = np.arange(len(node))
    for start, size in zip(first[m > _PAIRWISE], m[m > _PAIRWISE]):
        members = row[start:start + size]
        while (up := root[root[members]] != root[members]).any():
            root[members[up]] = root[root[members[up]]]
        if not own[members].any() or (root[members] == root[members[0]]).all():
            continue
        left = members
        while len(left) > 1:  # from one set on to those that may link, and on from these
            group, queue, left = [left[:1]], left[:1], left[1:]
            while len(queue) and len(left):
                step = max(1, (1 << 20) // (len(left) * bits.shape[1]))
                hit = close(queue[:step, None], left[None, :]).any(0)
                queue = np.concatenate([queue[step:], left[hit]])
                group.append(left[hit])
                left = left[~hit]
            roots = np.unique(root[np.concatenate(group)])
            a.append(node[roots[1:]])
            b.append(np.repeat(node[roots[0]], len(roots) - 1))
            root[roots] = roots[0]
    return np.concatenate(a or [node[:0]]), np.concatenate(b or [node[:0]])


def _candidates(index: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that join all classes that may link.

    ``index``: node, n, size, bits, and the prefixes in the order of the own
    range (``here``) and of the next (``above``). Rows are dealt by n-gram and
    range; a class comes once to each part with any of its n-grams.
    """
    sizes = Sizes(percent)
    python_workers(index.sparkSession)
    tokens = index.agg(F.sum(F.size("here") + F.size("above"))).first()[0] or 0
    parts = np.uint64(max(1, math.ceil(tokens / _PART_TOKENS)))

    def deal(batches):
        for batch in slices(batches):
            n, size, node = (batch.column(c).to_numpy() for c in ("n", "size", "node"))
            bits = batch.column("bits").to_pylist()
            for own, column in enumerate(("above", "here")):
                lists = batch.column(column)
                lengths = pc.list_value_length(lists).to_numpy()
                token, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), lengths)
                if not len(token):
                    continue
                at = size + 1 - own
                part = (token.view(np.uint64) ^ (at[row].astype(np.uint64) * _MIX[0])) * _MIX[1]
                part = ((part >> np.uint64(33)) % parts).astype(np.int64)
                order = np.lexsort((part, row))
                token, part, row = token[order], part[order], row[order]
                first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
                of = row[first]
                short = {i: halved(bits[i], sizes.words(int(at[i]))) for i in np.unique(of).tolist()}
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[first]), pa.array(at[of]), pa.array(np.full(len(of), own, np.int64)), pa.array(node[of]), pa.array(n[of]),
                    pa.ListArray.from_arrays(pa.array(np.r_[first, len(token)], pa.int32()), pa.array(token)),
                    pa.array([short[i] for i in of.tolist()], pa.binary())],
                    names=["part", "size", "own", "node", "n", "tokens", "bits"])

    def meet(table: pa.Table) -> pa.Table:
        a, b = [], []
        table = table.combine_chunks().sort_by("size")
        size = table["size"].to_numpy()
        cuts = np.r_[np.flatnonzero(np.r_[True, size[1:] != size[:-1]]), len(size)].tolist()
        for start, stop in zip(cuts, cuts[1:]):
            t = table.slice(start, stop - start).combine_chunks()
            lists = t["tokens"].combine_chunks()
            row = np.repeat(np.arange(len(t)), pc.list_value_length(lists).to_numpy())
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), "<u8").reshape(len(t), -1)
            x, y = may_link(t["node"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy() > 0, bits, row,
                            lists.flatten().to_numpy(), percent)
            a.append(x)
            b.append(y)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt = index.select("n", "size", "node", "bits", "here", "above").mapInArrow(
        deal, "part long, size long, own long, node long, n long, tokens array<long>, bits binary")
    return dealt.groupBy("part").applyInArrow(meet, "a long, b long")


class _Node:
    __slots__ = ("ngrams", "depth", "children", "least", "most", "group", "ends")

    def __init__(self, ngrams, depth, least, most, group):
        self.ngrams, self.depth = ngrams, depth  # the path's last n-grams; n-grams on the path down to here
        self.least, self.most = least, most  # sizes of the sets below
        self.group = group  # a member, if all sets below are in one class, else -1
        self.children, self.ends = {}, []


def link_classes(sets: list[np.ndarray], percent: int, start: list | None = None) -> list[int]:
    """Class of each set (a member's index) under chains of links; ``start``: labels that are linked already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if start is not None:
        first: dict = {}
        for i, label in enumerate(start):
            root[i] = find(first.setdefault(label, i))
    sizes = [len(s) for s in sets]
    if not sets:
        return []
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -counts))] = np.arange(len(every))  # common n-grams first
    cuts = np.cumsum(sizes)[:-1]
    paths = [np.sort(p) for p in np.split(rank[inverse], cuts)]
    has = np.zeros(len(every), bool)
    top = _Node(paths[0][:0], 0, 1 << 60, 0, -2)
    for x in order:
        path, n = paths[x], sizes[x]
        has[path] = True
        low, high = -(-percent * n // 100), 100 * n // percent
        stack = [(top, 0)]
        while stack:
            node, shared = stack.pop()
            if node.most < low or node.least > high or (node.group >= 0 and find(node.group) == find(x)):
                continue
            if len(node.ngrams):
                shared += int(has[node.ngrams].sum())
                passed = int(np.searchsorted(path, node.ngrams[-1], "right"))  # own n-grams up to here
                reach = min(shared + node.most - node.depth, n - (passed - shared))
                if 100 * reach < percent * (n + node.depth - shared):
                    continue
            for y in node.ends:
                if 100 * shared >= percent * (n + sizes[y] - shared):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
            stack.extend((child, shared) for child in node.children.values())
        has[path] = False
        # store the set: follow its path, splitting a node where the paths part
        node, at = top, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.group == -2:
                node.group = x
            elif node.group >= 0 and find(node.group) != find(x):
                node.group = -1
            if at == n:
                node.ends.append(x)
                break
            child = node.children.get(int(path[at]))
            if child is None:
                leaf = _Node(path[at:], n, n, n, x)
                leaf.ends.append(x)
                node.children[int(path[at])] = leaf
                break
            width = min(len(child.ngrams), n - at)
            part = np.flatnonzero(child.ngrams[:width] != path[at:at + width])
            same = int(part[0]) if len(part) else width
            if same < len(child.ngrams):
                upper = _Node(child.ngrams[:same], child.depth - len(child.ngrams) + same, child.least, child.most, child.group)
                child.ngrams = child.ngrams[same:]
                upper.children[int(child.ngrams[0])] = child
                node.children[int(path[at])] = upper
                child = upper
            node, at = child, at + same
    return [find(i) for i in range(len(sets))]


_CELL = ("cell_a", "cell_b", "cluster", "node", "label", "s1", "s2", "text")


def _linked(cells: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges ``a, b`` (member, least member of its class) within each cell.

    ``cells`` has the columns of ``_CELL``: texts travel, as they are smaller
    than their sets. A text that is not the node's (another text under the
    same doc_id) is left out. A cell may hold many small clusters; each is
    joined alone.
    """
    python_workers(cells.sparkSession)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        by = defaultdict(dict)
        for cluster, node, label, s1, s2, text in zip(*[pdf[c] for c in _CELL[2:]]):
            ngrams = ngram_set(text, n)
            if signature(ngrams) == (s1, s2):
                by[cluster][node] = label, ngrams
        a, b = [], []
        for members in by.values():
            nodes = sorted(members)
            found = link_classes([members[i][1] for i in nodes], percent, [members[i][0] for i in nodes])
            least: dict = {}
            for i, g in zip(nodes, found):
                least.setdefault(g, i)
            a += nodes
            b += [least[g] for g in found]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return cells.select(*_CELL).groupBy("cell_a", "cell_b").applyInPandas(join, "a long, b long").where("a != b")


def _large_clusters(texts: DataFrame, found: DataFrame, n: int, percent: int, cell_ngrams: int) -> DataFrame:
    """Edges between the cells of clusters that were dealt into several cells; see step 4 above.

    ``texts``: cluster, parts, node, n, s1, s2, text of those clusters;
    ``found``: edges within their cells.
    """
    slim_sets = texts.select("cluster", "node", "n")
    own = found.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = materialize(slim_sets.join(own, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    leaders = labels.groupBy("cluster", "label").agg(
        F.min_by("node", "n").alias("x"), F.max_by("node", "n").alias("y"))
    leaders = leaders.select("cluster", "label", F.explode(F.array_distinct(F.array("label", "x", "y"))).alias("node"))
    leaders = materialize(leaders.join(slim_sets.select("node", "n"), "node"), "leaders")
    parts = leaders.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(cell_ngrams)).alias("parts"))
    cells = leaders.join(parts, "cluster").withColumn("cell_b", F.pmod(F.xxhash64("label"), F.col("parts")))
    own_text = texts.select("node", "s1", "s2", "text")
    between = materialize(_linked(cells.select("cluster", "node", "label", "cell_b").join(
        own_text, "node").withColumn("cell_a", F.col("cluster")), n, percent), "between")
    merged = components(between.unionByName(found).join(slim_sets.select(F.col("node").alias("a")), "a"))
    merged = merged.select("node", F.col("component").alias("merged"))
    labels = materialize(labels.join(merged, "node", "left").withColumn("label", F.coalesce("merged", "label")).select(
        "cluster", "node", "n", "label"), "merged")
    counts = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("docs"))
    largest = counts.groupBy("cluster").agg(F.max_by("label", F.struct("docs", "label")).alias("largest"),
                                            F.count(F.lit(1)).alias("classes")).where("classes > 1")
    open_ = materialize(labels.join(largest, "cluster").withColumn("outside", F.col("label") != F.col("largest")), "open")
    chunks = open_.where("outside").groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(cell_ngrams)).cast("int").alias("chunks"))
    open_ = open_.join(chunks, "cluster").join(texts.select("node", "parts", "s1", "s2", "text"), "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    # cell (part i, chunk c): every document of part i in every chunk's cell, every outside document in its chunk's
    all_rows = open_.withColumn("i", part).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    outside = open_.where("outside").withColumn("c", chunk).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    cells = all_rows.unionByName(outside).withColumn(
        "cell_a", F.col("cluster")).withColumn("cell_b", F.col("i").cast("long") * F.col("chunks") + F.col("c"))
    return between.unionByName(_linked(cells, n, percent))


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90, cell_ngrams: int = 2_000_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Links: 100 * intersection >= ``percent`` * union of the n-gram sets
    (any value is right; the higher, the shorter the prefixes).
    A null or empty text, or one of white space, has the empty set and links
    with nothing. A text of fewer than ``n`` words is one n-gram. Texts of
    any length are taken whole. Repeated rows get equal results. Rows that
    share a doc_id are one document: if their texts differ, their classes
    are joined. A row without doc_id keeps its count, links nothing and has
    no component. An empty table gives an empty result; extra columns are
    ignored.
    """

    sizes = Sizes(percent)

    def make():
        def columns(texts: list) -> tuple:
            out = [[] for _ in range(11)]
            for text in texts:
                s = ngram_set(text, n)
                size = sizes.of(len(s)) if len(s) else 0
                prefix = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                top = [sizes.counted(size), sizes.counted(size + 1)]
                k = np.searchsorted(s, np.array(top, np.uint64)).tolist()
                signed = (s[:max(prefix, *k)] ^ _TOP).view(np.int64)
                for column, x in zip(out, (len(s), *signature(s), size, *k, int((top[1] ^ _TOP).view(np.int64)), signed[:k[0]],
                                           signed[k[0]:max(prefix, k[0])], signed[k[1]:max(prefix, k[1])],
                                           parities(s, sizes.words(size + 1)))):
                    column.append(x)
            return tuple(out)

        return columns

    rows = materialize(with_text_columns(slim(docs), (
        "n long, s1 long, s2 long, size long, k0 int, k1 int, top long, counted array<long>, "
        "filled0 array<long>, filled1 array<long>, bits binary"), make), "sets")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *[
        F.any_value(c).alias(c) for c in ("n", "size", "k0", "k1", "top", "counted", "filled0", "filled1", "bits")])
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # document frequency of the counted n-grams, and each class's shared ones
    tokens = classes.select("node", F.explode("counted").alias("token"))
    shared = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    held = shared.groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    # the prefix starts with the class's own n-grams; if they fill it, nothing is left to find
    length = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1
    narrow = classes.select("node", "n", "size", "k0", "k1", "top", "filled0", "filled1", "bits").join(held, "node", "left")
    narrow = narrow.withColumn("shared0", F.array_sort(F.coalesce(
        "shared", F.expr("cast(array() as array<struct<df:bigint,token:bigint>>)"))))
    narrow = narrow.withColumn("shared1", F.filter("shared0", lambda t: t["token"] < F.col("top")))

    def prefix(i: int) -> Column:
        left = (length - (F.col(f"k{i}") - F.size(f"shared{i}"))).cast("int")
        tokens = F.concat(F.transform(F.slice(f"shared{i}", F.lit(1), left), lambda t: t["token"]), f"filled{i}")
        return F.when(left > 0, tokens).otherwise(F.expr("cast(array() as array<bigint>)"))

    index = narrow.select("node", "n", "size", "bits", prefix(0).alias("here"), prefix(1).alias("above"))
    index = materialize(index.where("size(here) + size(above) > 0"), "index")
    near = materialize(_candidates(index, percent).distinct(), "near")
    clusters = components(near).select("node", F.col("component").alias("cluster"))

    # cells: small clusters share one, a large one is dealt into several
    members = classes.select("node", "rep", "n", "s1", "s2").join(clusters, "node")
    members = materialize(members.withColumn("label", F.col("node")), "members")
    totals = members.groupBy("cluster").agg(F.sum("n").alias("ngrams_in")).withColumn(
        "parts", F.ceil(F.col("ngrams_in") / F.lit(cell_ngrams)))
    totals = materialize(totals, "totals")
    small, large = totals.agg(F.sum(F.when(F.col("parts") == 1, F.col("ngrams_in"))),
                              F.count(F.when(F.col("parts") > 1, 1))).first()
    bins = max(1, math.ceil((small or 0) / cell_ngrams))
    whole = F.col("parts") == 1
    placed = materialize(members.join(totals.select("cluster", "parts"), "cluster").withColumns({
        "cell_a": F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")),
        "cell_b": F.when(whole, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))),
    }), "placed")
    ids = materialize(placed.select("rep").distinct(), "ids")  # small enough to be broadcast, it spares shuffling all texts
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, "rep", "left_semi").join(placed, "rep")
    found = materialize(_linked(texts, n, percent), "links")
    # a document with several texts joins their classes
    named = rows.join(classes.select("s1", "s2", "node"), ["s1", "s2"], "left").select("doc_id", "n", "node")
    named = materialize(named, "named")
    several = named.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("doc_id", "b")
    several = materialize(named.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a > b"), "several")
    if large:
        big = materialize(texts.where("parts > 1").select("cluster", "parts", "node", "n", "s1", "s2", "text"), "large")
        links = found.unionByName(_large_clusters(big, found, n, percent, cell_ngrams)).unionByName(several)
        joined = components(links)
    elif several.isEmpty():
        joined = found.select(F.col("a").alias("node"), F.col("b").alias("component"))  # stars: already labels
    else:
        joined = components(found.unionByName(several))
    of = classes.select("node", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = materialize(of.join(least, "component").select("node", "component_id"), "answer")
    return named.join(answer, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
