"""License scan, hard negatives and spelling variants against brute force, and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loyalframe.llm import license_scan as L
from loyalframe.llm import spelling_variants as S
from loyalframe.llm.hard_negatives import hard_negatives, pack_planes, scores_of
from loyalframe.llm.license_scan import NOTICES, PHRASES, license_report, scan_licenses
from tests.llm.test_operators import ODD, SF, documents, odd_documents

LETTER = "A-Za-zÀ-ÿ"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11: licenses

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_phrases(text):
    w = words(text)
    return sorted((i, i + len(p), label) for label, phrase in PHRASES for p in [phrase.split()]
                  for i in range(len(w)) if w[i:i + len(p)] == p)


def test_phrases_equal_brute_force(spark):
    rnd = random.Random(3)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x"]
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 120))), None, None, None) for i in range(120)]
    rows += [(200, "cc by nc " * 20_000, None, None, None), (201, "Under  THE\nMIT-License!", None, None, None), (202, "cc by", None, None, None)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), keep=("text",))
    for r in got.collect():
        assert r.n_words == len(words(r.text))
        assert sorted((s.start, s.end, s.label) for s in r.spans if s.exact) == brute_phrases(r.text), r.doc_id
        assert all(0 < s.score <= 1 and s.start < s.end <= r.n_words for s in r.spans)


def brute_notices(text, k=3, min_votes=3, gap=8, coverage=0.75):
    """Spans (start, end, label, score) of all notices, straight from the rules."""
    w, out = words(text), []
    for label, notice in NOTICES:
        t = words(notice)
        along = defaultdict(set)
        for d in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[d:d + k] == t[j:j + k]:
                    along[d - j].add(j)
        strong = sorted(g for g, js in along.items() if len(js) >= min(min_votes, len(t) - k + 1))
        groups = []
        for g in strong:
            if groups and g - groups[-1][-1] <= gap:
                groups[-1].append(g)
            else:
                groups.append([g])
        for group in groups:
            share = len({j + o for g in group for j in along[g] for o in range(k)}) / len(t)
            start, end = min(g + min(along[g]) for g in group), max(g + max(along[g]) for g in group) + k
            if share >= coverage and end - start <= 2 * len(t):
                out.append((start, end, label, share))
    kept, island = [], []
    for span in [*sorted(out), (math.inf, math.inf, "", 0)]:
        if island and span[0] >= max(s[1] for s in island):
            kept += [s for s in island if s[3] == max(s[3] for s in island)]
            island = []
        island.append(span)
    return kept


def test_changed_notices_are_found_and_other_texts_left_alone(spark):
    rnd = random.Random(4)
    rows = []
    for i, (label, notice) in enumerate(NOTICES):
        w = notice.split()
        dropped = w[:len(w) // 2] + w[len(w) // 2 + 1:]
        added = w[:len(w) // 3] + ["indeed", "really"] + w[len(w) // 3:]
        for j, v in enumerate((w, dropped, added)):
            filler = [f"w{rnd.randint(0, 500)}" for _ in range(60)]
            rows.append((10 * i + j, " ".join([*filler[:30], *v, *filler[30:]]), label))
    rows.append((1000, "this work is licensed under the terms below and this program is free software", ""))
    rows.append((1001, " ".join(f"w{rnd.randint(0, 50)}" for _ in range(5000)), ""))
    rows.append((1002, " ".join(t for _, t in NOTICES) * 3, "all"))
    got = {r.doc_id: r.spans for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, label string").drop("label")).collect()}
    found = 0
    for i, text, label in rows:
        want = brute_notices(text)
        assert sorted((s.start, s.end, s.label, s.score) for s in got[i] if not s.exact) == sorted(want), (i, label)
        if i < 1000:
            assert (i % 10 > 0 and not want) or {s[2] for s in want} == {label}, (i, want)
            found += bool(want)
    assert found > 0.8 * 3 * len(NOTICES) and not got[1000] and not got[1001]


def test_license_odd_inputs(spark):
    odd = odd_documents(spark, (9, "Released under the MIT License, under the mit license", "en", "s", 1),
                        (9, "Released under the MIT License, under the mit license", "en", "s", 1))
    got = license_report(odd)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert [tuple(r)[1:] for r in rows if r.doc_id == 9] == [(9, 2, 1, 5, "mit", "mit", 1.0)] * 2
    assert {tuple(r)[1:] for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0, None, None, "", "", 0.0)}
    assert license_report(odd.limit(0)).count() == 0
    assert {r.labels for r in license_report(odd, phrases=(), notices=()).collect()} == {""}
    assert "clash" in {r.score for r in scan_licenses(odd.withColumn("score", F.lit("clash")), keep=("score",)).collect()}
    with pytest.raises(Exception, match="template shorter"):
        scan_licenses(odd, phrases=(("short", "two words"),))


def test_only_grams_of_template_words_are_made(spark, monkeypatch):
    odd = ["", "a", "Under THE Mit-License", "\u212aeep \u0130 \u00c9T\u00c9 stra\u00dfe \u1e9e \u03a3\u0391\u03a3 Mit",
           "x\x7fY\x80z\u0085Q\u00a0R[S]T`U{V}W@X:Y/Z", "\U0001f600a \U0010ffffB \ud7ffC \ue000 Z_z 0:9;", "CC by\tNC\x0bBY\x0cnc", "\u6f22\u5b57 ABC"]
    vocabulary = L.vocabulary_of(t for _, t in PHRASES)
    assert vocabulary == sorted({w for _, t in PHRASES for w in words(t)})
    rows = spark.createDataFrame([(t,) for t in [*odd, *(" x ".join(PHRASES[0][1].split()[:j]) for j in range(5)), " ".join(t for _, t in PHRASES)]],
                                 "text string").select("text", L.words_of(F.col("text")).alias("tw"))
    for r in rows.select("*", L.grams_of("tw", 3).alias("every"), L.grams_of("tw", 3, vocabulary).alias("some")).collect():
        w = words(r.text)
        assert r.tw == w
        every = [(i, " ".join(w[i:i + 3])) for i in range(len(w) - 2)]
        assert [(g["at"], g["said"]) for g in r.every] == every
        assert [(g["at"], g["said"]) for g in r.some] == [g for g in every if set(g[1].split()) <= set(vocabulary)]
    docs = spark.createDataFrame([(i, f"{a} {b}") for i, (_, a) in enumerate(NOTICES) for _, b in PHRASES], "doc_id long, text string")
    listed = Counter(map(str, license_report(docs).collect()))
    monkeypatch.setattr(L, "LISTED_WORDS", 0)  # too many to list: every gram is joined
    assert L.vocabulary_of(["of the"]) is None
    assert Counter(map(str, license_report(docs).collect())) == listed


# 12: hard negatives

def test_lookup_scores_are_inner_products():
    rnd = np.random.default_rng(1)
    for dim, size in ((1, 3), (7, 200), (8, 255), (20, 1 << 40), (64, 1)):
        v = rnd.integers(-size, size + 1, (50, dim))
        a = rnd.integers(-size if size < 1 << 30 else -5, 6, (9, dim))
        planes = int(np.abs(v).max()).bit_length() + 1
        assert (scores_of(a, pack_planes(v, planes)) == v @ a.T).all()


def brute_negatives(rows, step, scale=256, n_pos=5, n_neg=3):
    good = sorted({(r.vec_id, r.label, tuple(math.floor(scale * x) for x in r.embedding)) for r in rows
                   if None not in (r.vec_id, r.label, r.embedding) and r.embedding
                   and all(x is not None and math.isfinite(x) for x in r.embedding)})
    out = []
    for i, label, v in good:
        if i % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m == label) for j, m, w in good if j != i and len(w) == len(v))
            for s, j, _ in [x for x in scored if x[2]][:n_pos]:
                band = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_neg]
                out += [(i, j, n + 1, m, -s, -t) for n, (t, m, _) in enumerate(band)]
    return Counter(out)


def test_hard_negatives_equal_brute_force(spark):
    rnd = random.Random(6)
    schema = "vec_id long, label int, embedding array<float>, rank int, key string, planes string, score string, v int"
    same = [0.5, 0.25, -0.125, 1.0, 0.0]  # a vector that many rows share: ties by id
    rows = [(i, rnd.choice([0, 0, 0, 1, 2]), same if i % 4 == 0 else [rnd.randint(-8, 16) / 16 for _ in range(5)]) for i in range(400)]
    rows += [(1000, None, same), (None, 1, same), (1050, 1, None), (1100, 1, []), (1150, 1, [1.0, None, 1.0, 1.0, 1.0]),
             (1200, 1, [math.nan] * 5), (1250, 1, [math.inf] * 5), (50, rows[50][1], rows[50][2]), (1300, 9, [1.0] * 5),
             (1350, 1, [1.0, 1.0]), (1400, 2, [1.0, 0.9]), (1401, 1, [0.9, 0.9]), (100, 2, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "k", "p", "s", 7) for r in rows], schema)
    want = brute_negatives(df.collect(), 50)
    assert want
    for blocks in ((2048, 16384), (3, 60)):
        got = hard_negatives(df, F.col("vec_id") % 50 == 0, anchor_block=blocks[0], candidate_block=blocks[1])
        assert Counter(tuple(r) for r in got.collect()) == want
    assert hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(df.where("vec_id % 50 != 0"), F.col("vec_id") % 50 == 0).count() == 0


# 13: spelling variants

def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(f"[{LETTER}]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    keys = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            keys["r", w[:i], w[i + 1:]].add(w)
            keys["d", w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for key, group in keys.items():
        if key[0] == "r":
            for w in group:
                near[w] |= group - {w}
        elif key[1] in n:
            near[key[1]] |= group
            for w in group:
                near[w].add(key[1])
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items())


def misspelt(seed=8):
    rnd = random.Random(seed)
    rows = []
    for base, n in (("beautiful", 1500), ("necessary", 400), ("séparément", 300), ("ßtraßenÄ", 120), ("aaaaaaaa", 200)):
        for i in range(n):
            w = list(base)
            while rnd.random() < 0.15:
                at = rnd.randrange(len(w))
                w[at:at + 1] = rnd.choice([[], [rnd.choice("abeé")], [w[at], rnd.choice("abeé")]])
            rows.append("".join(w))
    rows += ["chainword"] * 700 + ["chainwords"] * 60 + ["chainwordss"] * 4
    rnd.shuffle(rows)
    return [(i, ", ".join(rows[i::50]) + " Short WORDS1beautiful2") for i in range(50)]


def test_variants_equal_brute_force(spark):
    rows = misspelt() + [(50, None), (51, ""), (52, "123 !"), (None, "beautiful beautifule"), (53, "x" * 50_000 + " " + "x" * 50_000),
                         (54, "x" * 49_999 + " " + "x" * 49_999), (7, "beautiful " * 3), (7, "beautiful " * 3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute_variants(rows)
    assert sum(r[1] is not None for r in want) > 50 and ("chainwordss", "chainwords", "chainword") in {r[:3] for r in want}
    for more in ({}, {"filter_bytes": 200}, {"bits": 1}):
        got = S.spelling_variants(df, **more)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want, more
    assert S.spelling_variants(df.limit(0)).count() == 0
    assert S.spelling_variants(odd_documents(spark)).columns == got.columns


def test_variants_of_the_documents(spark):
    docs = documents(spark)
    got = sorted(map(tuple, S.spelling_variants(docs).collect()), key=lambda r: r[0])
    assert got == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_filters_lose_nothing_and_stop_most():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)})
    h = S.word_hashes(words)
    blocks = math.ceil(len(words) * 12 / 256) + 1
    block, masks = S.block_masks(h, np.uint64(blocks))
    rows = np.zeros((blocks, 4), np.uint64)
    for j in range(4):
        np.bitwise_or.at(rows[:, j], block, masks[j])
    filters = S.Filters({9: rows}, 0, 1)
    assert len(filters.may_hold(h, 9)) == len(words) and len(filters.may_hold(h, 8)) == 0
    other = S.word_hashes(["".join(rnd.choice("klmnopqrst") for _ in range(9)) for _ in range(20_000)])
    assert len(filters.may_hold(other, 9)) < 0.02 * len(other)


def test_edit_hashes_equal_the_words():
    word, letters = "aabbcçd", np.frombuffer("abcdç".encode("latin-1"), np.uint8)

    class All:
        tables = {6: 1, 7: 1}
        seen: set = set()

        def may_hold(self, h, length):
            return np.arange(len(h))

    _, got = S.edits_of([word], letters, All())
    cuts = {word[:i] + word[i + 1:] for i in range(7)}
    swaps = {word[:i] + c + word[i + 1:] for i in range(7) for c in "abcdç" if c > word[i]}
    assert sorted(got.tolist()) == sorted(S.word_hashes(sorted(cuts)).tolist() + S.word_hashes(sorted(swaps)).tolist())


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)] + [("other", "end")], "word string, form string")
    got = {r.word: r.root for r in S.roots(forms).collect()}
    assert got == {**{f"w{i}": "w19" for i in range(19)}, "other": "end"}
