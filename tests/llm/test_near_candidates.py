"""Sets that share n-grams by chance alone make no chains of candidates; sets that link always do."""

import random

import numpy as np
import pytest

from loyalframe.llm import ngram_trie_join
from tests.llm.test_operators import DOC, brute_classes


def common_words(texts, words, seed=1):
    """Texts of few different words: nearly every run of three is in other texts too."""
    rnd = random.Random(seed)
    return [[f"w{rnd.randrange(12)}" for _ in range(words)] for _ in range(texts)]


def test_common_ngrams_make_no_large_cluster(spark, monkeypatch):
    texts = common_words(300, 60)
    texts += [[*t[:-1], f"end{i}"] for i, t in enumerate(texts[:3])] + [[f"start{i}", *texts[7][1:]] for i in range(20)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    met, linked = [], ngram_trie_join._linked

    def watched(cells, *more):
        met.extend(r["count"] for r in cells.groupBy("cluster").count().collect())
        return linked(cells, *more)

    monkeypatch.setattr(ngram_trie_join, "_linked", watched)
    got = ngram_trie_join.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()
    want = brute_classes([r[:2] for r in rows])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert sorted(met)[-4:] == [2, 2, 2, 21]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_linked_sets_may_link(percent):
    rnd = random.Random(percent)
    sizes = ngram_trie_join.Sizes(percent)
    every = [rnd.getrandbits(64) for _ in range(400)]
    sets = []
    for _ in range(40):
        base = set(rnd.sample(every, rnd.choice([1, 3, 40, 200])))
        for _ in range(rnd.choice([1, 2, 25])):
            sets.append(np.array(sorted(set(rnd.sample(sorted(base), rnd.randint(max(1, len(base) - 9), len(base))))
                                        | set(rnd.sample(every, rnd.choice([0, 1, 9])))), np.uint64))
    link = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b
            and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
    assert link
    at = [sizes.of(len(s)) for s in sets]
    for a, b in link:
        assert abs(at[a] - at[b]) <= 1
    root = list(range(len(sets)))
    for size in sorted({*at, *[i + 1 for i in at]}):
        rows = [i for i in range(len(sets)) if at[i] in (size, size - 1)]
        words = sizes.words(size)
        bits = [ngram_trie_join.halved(ngram_trie_join.parities(sets[i], sizes.words(at[i] + 1)), words) for i in rows]
        assert bits == [ngram_trie_join.parities(sets[i], words) for i in rows]
        row, token = zip(*[(r, x) for r, i in enumerate(rows) for x in sets[i].view(np.int64).tolist()])
        found = ngram_trie_join.may_link(
            np.array(rows), np.array([len(sets[i]) for i in rows]), np.array([at[i] == size for i in rows]),
            np.frombuffer(b"".join(bits), "<u8").reshape(len(rows), -1), np.array(row), np.array(token), percent)
        for a, b in zip(*[x.tolist() for x in found]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert all(root[a] == root[b] for a, b in link)
    assert all(sizes.counted(s) >= sizes.counted(s + 1) for s in at)
