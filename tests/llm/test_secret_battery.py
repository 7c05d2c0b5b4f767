"""The randomness battery and span placement against a plain restatement."""

import math
import random
import re
import time
from collections import Counter, defaultdict

from loyalframe.llm import randomness_secrets as R
from tests.llm.test_operators import DOC, brute_secrets


def base_spans(text):
    return [(int(s), int(e)) for s, e in (x.split(":")[1:] for x in brute_secrets(text).split(",") if x)]


def candidates(text, least=20):
    taken, found = base_spans(text), set()
    for chars in R.TOKEN_CHARS:
        for m in re.finditer(f"{chars}{{{least - R.PADDING},}}=*", text, re.ASCII):
            if len(m[0]) >= least and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                if not any(s < m.end() and m.start() < e for s, e in taken):
                    found.add((m.start(), m.end(), m[0]))
    return found


def battery_of(token, z_limit=3.4):
    """(stratum, passes the battery, bin) of a token, None without an encoding."""
    body = token.rstrip("=")
    for enc, (pattern, alphabet, kappa) in R.ENCODINGS.items():
        if re.fullmatch(pattern, body):
            break
    else:
        return None
    code, n, m = [alphabet.index(c) for c in body], len(body), len(alphabet)
    squares = sum(v * v for v in Counter(code).values())
    mean, high = sum(code) / n, sum(c >= m / 2 for c in code)
    runs = 1 + sum((a >= m / 2) != (b >= m / 2) for a, b in zip(code, code[1:]))
    pairs, expected = (squares - n) / 2, n * (n - 1) / 2 * kappa
    chi = (m / n * squares - n - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
    both = 2 * high * (n - high)
    z_runs = 99 if high in (0, n) else abs(runs - 1 - both / n) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 0.01))
    serial = math.sqrt(n) * abs(sum((a - mean) * (b - mean) for a, b in zip(code, code[1:])) / max(sum((c - mean) ** 2 for c in code), 1e-9))
    bound = 0 if pairs >= expected else math.floor(10 / math.log(10) * (
        expected - pairs + (pairs * math.log(pairs / expected) if pairs > 0 else 0)))
    return f"{enc}:{math.floor(2 * math.log2(n))}", max(chi, z_runs, serial) <= z_limit, bound


def random_spans(texts, fdr=0.01):
    """Accepted spans per text: the battery, Benjamini-Hochberg per stratum, the outermost of nested runs."""
    judged = {t: battery_of(t) for text in texts for _, _, t in candidates(text)}
    strata = defaultdict(list)
    for t, j in judged.items():
        if j:
            strata[j[0]].append(j[2])
    least = {}
    for stratum, bins in strata.items():
        good = [b for b in set(bins) if 10 ** (-b / 10) * len(bins) / sum(x >= b for x in bins) <= fdr]
        if good:
            least[stratum] = min(good)
    out = []
    for text in texts:
        spans = [(s, e) for s, e, t in candidates(text) if judged[t] and judged[t][1] and judged[t][2] >= least.get(judged[t][0], math.inf)]
        out.append(sorted((s, e) for s, e in spans if not any(a <= s and e <= b and b - a > e - s for a, b in spans)))
    return out


def test_random_spans_equal_brute_force(spark):
    rnd = random.Random(12)
    sets = [R.DIGITS + R.UPPER + R.LOWER, R.UPPER + R.LOWER + R.DIGITS + "+/", R.UPPER + R.LOWER + R.DIGITS + "-_", R.UPPER + "234567",
            R.DIGITS + "ABCDEF", R.DIGITS + R.LOWER]
    joins = [" ", "", "/", "_", "=", "==", "-", "é", "; token="]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            alphabet = rnd.choice(sets)
            word = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([5, 19, 20, 24, 33, 40, 64])))
            if rnd.random() < 0.3:
                word = rnd.choice(["the1letters", "aaaabbbb11", "user_name_2_of", "x1"]) * rnd.randint(1, 5)
            parts += [word, rnd.choice(joins)]
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.added for r in R.scan_secrets(df).collect()}
    want = random_spans(texts)
    assert sum(map(len, want)) > 100
    for i, spans in enumerate(want):
        assert sorted((a.start, a.end) for a in got[i]) == spans, texts[i]


def test_a_text_of_very_many_matches_is_placed_in_seconds(spark):
    rnd = random.Random(13)
    runs = ["%024x" % rnd.getrandbits(96) for _ in range(40_000)]
    keys = ["".join(rnd.choice(R.DIGITS + R.UPPER + R.LOWER) for _ in range(26)) for _ in range(5_000)]
    text = "é ".join(r + (" " + keys[i // 8] if i % 8 == 0 else "") for i, r in enumerate(runs))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text, None, None, None), (2, "x", None, None, None)], DOC)
    began = time.time()
    got = {r.doc_id: r for r in R.scan_secrets(df).collect()}
    assert time.time() - began < 90
    assert ",".join(f"{a.kind}:{a.start}:{a.end}" for a in got[1].base) == brute_secrets(text)
    assert len(got[1].base) == 40_000 and not got[2].base
