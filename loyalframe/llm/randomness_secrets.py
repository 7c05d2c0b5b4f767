"""Secret scans: exact patterns, plus a battery of randomness tests on unknown tokens.

Candidates are maximal runs over each set of token characters (letters and
digits, also with ``+/``, also with ``_-``), at least ``min_length`` long, with
a letter and a digit; ``=`` may only end them, as padding. So the value of
``NAME=VALUE`` is a candidate, as is a token behind a URL path; a run that mixes
``+/`` with ``_-`` is split at either. For each an encoding is inferred (its
alphabet of ``m`` symbols) and three statistics are taken on the symbols:

* chi-squared uniformity over the alphabet,
* a runs test on symbols above / below the alphabet's middle,
* the lag-1 serial correlation of the symbol numbers.

A token that deviates from randomness by more than ``z_limit`` standard
deviations in any test is no secret. For the rest the question is whether
natural text could look that uniform: with ``c`` equal pairs of symbols
seen and ``mu`` expected from unevenly used symbols, the Poisson tail
``exp(c - mu) * (mu / c) ** c`` bounds the chance. ``mu`` grows with the
square of the length, so short tokens have weak evidence. Within each
stratum (encoding, length class) the Benjamini-Hochberg rule on these
p-values, over the distinct tokens of the corpus, holds the share of false
discoveries below ``fdr``. P-values are counted in logarithmic bins, so the
rule needs one aggregate and a window over bins, never over tokens.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, text_of

# fixed values: the three exact patterns
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BASE_KINDS = ("assign", "access", "hex")
ADDED_KIND = "random"
# a run of 24 or more is the same match as a run of any length, then dropped if shorter
LONG_HEX = "[0-9a-f]{24,}"
TOKEN_CHARS = ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]", "[A-Za-z0-9]")
PADDING = 2  # signs of padding that count for the least length
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# encoding: (pattern of the body, alphabet, sum of squared symbol shares that uneven natural use has at least)
ENCODINGS = {
    "hex": ("[0-9a-f]+", DIGITS + "abcdef", 0.1),
    "HEX": ("[0-9A-F]+", DIGITS + "ABCDEF", 0.1),
    "base32": ("[A-Z2-7]+", UPPER + "234567", 0.06),
    "upper36": ("[A-Z0-9]+", DIGITS + UPPER, 0.06),
    "lower36": ("[a-z0-9]+", DIGITS + LOWER, 0.06),
    "base62": ("[A-Za-z0-9]+", DIGITS + UPPER + LOWER, 0.05),
    "base64": ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/", 0.05),
    "base64url": ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_", 0.05),
}


# steps of a doubling scan or a binary search over arrays of any length
_STEPS = "sequence(0, 30)"


def _scan(values: str, joined: str) -> str:
    """Running totals of an array, ``joined`` combining (x, y): log(n) passes over it, each adding what is 2**p places back."""
    at = "i - shiftleft(1, p)"
    more = joined.format(x="x", y=f"acc[{at}]")
    return f"""aggregate({_STEPS}, {values}, (acc, p) -> IF(size(acc) > shiftleft(1, p),
        transform(acc, (x, i) -> IF({at} >= 0, {more}, x)), acc))"""


def _count_before(spans: str, end: str) -> str:
    """How many of ``spans``, sorted by start, start before ``end``: a binary search."""
    step = "shiftleft(1, 30 - p)"
    return f"""aggregate({_STEPS}, 0, (n, p) -> IF(cast(n as bigint) + {step} <= size({spans}) AND
        {spans}[cast(least(cast(n as bigint) + {step}, size({spans})) as int) - 1].start < {end}, n + {step}, n))"""


def _placed(found: str, gaps: str) -> Column:
    """Matches with code-point positions, from the matches and the text between them.

    Both are arguments, not read inside a function: an expression that the
    optimizer moves into one would be evaluated for every match.
    """
    lengths = f"zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> length(g) + length(m))"
    return F.expr(f"""zip_with({found}, {_scan(lengths, "{x} + {y}")}, (m, e) -> named_struct('start', e - length(m), 'm', m))""")


def _find(df: DataFrame, name: str, pattern: str, keep: str) -> DataFrame:
    """Add ``name``: array of (start, end, m), the pattern's matches that satisfy ``keep`` (SQL over ``m``)."""
    found, gaps = f"_{name}_m", f"_{name}_g"
    df = df.withColumn(found, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split("_text", pattern, -1)))
    spans = F.when(F.size(found) > 0, _placed(found, gaps)).otherwise(
        F.expr("cast(array() as array<struct<start:int,m:string>>)"))
    df = df.withColumn(name, spans).drop(found, gaps)
    return df.withColumn(name, F.expr(f"""
        transform(filter({name}, x -> {keep}),
                  x -> named_struct('start', x.start, 'end', x.start + length(x.m), 'm', x.m))"""))


def _battery(df: DataFrame, cands: str, z_limit: float) -> DataFrame:
    """Replace array column ``cands`` by its random-looking tokens: (start, end, stratum, bin, id)."""
    case = "CASE " + " ".join(f"WHEN rlike(c.body, '^{p}$') THEN '{k}'" for k, (p, _, _) in ENCODINGS.items()) + " END"
    symbols = "element_at(map(" + ", ".join(f"'{k}', '{a}'" for k, (_, a, _) in ENCODINGS.items()) + "), c.enc)"
    kappa = "element_at(map(" + ", ".join(f"'{k}', {s}D" for k, (_, _, s) in ENCODINGS.items()) + "), c.enc)"

    def step(expr: str, source: str = cands) -> Column:
        return F.expr(f"transform({source}, c -> named_struct({expr}))")

    base = "'start', c.start, 'end', c.end, 'id', c.id"
    df = df.withColumn(cands, F.expr(
        f"transform({cands}, c -> named_struct('start', c.start, 'end', c.end, 'id', xxhash64(c.m), "
        "'body', rtrim('=', c.m)))"))
    df = df.withColumn(cands, step(f"{base}, 'body', c.body, 'enc', {case}"))
    df = df.withColumn(cands, F.expr(f"filter({cands}, c -> c.enc IS NOT NULL AND length(c.body) > 1)"))
    df = df.withColumn(cands, step(
        f"{base}, 'enc', c.enc, 'n', length(c.body), 'm', length({symbols}), 'kappa', {kappa}, "
        f"'code', transform(split(c.body, ''), s -> instr({symbols}, s) - 1)"))
    df = df.withColumn(cands, step(
        f"{base}, 'enc', c.enc, 'n', c.n, 'm', c.m, 'kappa', c.kappa, 'code', c.code, "
        "'squares', aggregate(array_distinct(c.code), 0D, (a, s) -> a + pow(size(filter(c.code, t -> t = s)), 2)), "
        "'mean', aggregate(c.code, 0D, (a, s) -> a + s) / c.n, "
        "'high', size(filter(c.code, s -> s >= c.m / 2)), "
        "'runs', 1 + aggregate(sequence(2, c.n), 0, (a, i) -> a + if((element_at(c.code, i) >= c.m / 2) "
        "!= (element_at(c.code, i - 1) >= c.m / 2), 1, 0))"))
    df = df.withColumn(cands, step(
        f"{base}, 'enc', c.enc, 'n', c.n, 'pairs', (c.squares - c.n) / 2, "
        "'expected', c.n * (c.n - 1D) / 2 * c.kappa, "
        "'z_chi', (c.m / c.n * c.squares - c.n - (c.m - 1)) / sqrt(2D * (c.m - 1) * (c.n - 1) / c.n), "
        "'z_runs', CASE WHEN c.high = 0 OR c.high = c.n THEN 99D ELSE abs(c.runs - 1 - 2D * c.high * (c.n - c.high) / c.n) "
        "/ sqrt(greatest(2D * c.high * (c.n - c.high) * (2D * c.high * (c.n - c.high) - c.n) "
        "/ (c.n * c.n * (c.n - 1D)), 0.01D)) END, "
        "'z_serial', sqrt(c.n) * abs(aggregate(sequence(2, c.n), 0D, (a, i) -> a "
        "+ (element_at(c.code, i) - c.mean) * (element_at(c.code, i - 1) - c.mean)) "
        "/ greatest(aggregate(c.code, 0D, (a, s) -> a + pow(s - c.mean, 2)), 1e-9D))"))
    # -10 log10 of the Poisson bound; 0 where there are as many equal pairs as uneven use gives
    df = df.withColumn(cands, step(
        f"{base}, 'stratum', concat(c.enc, ':', cast(floor(2 * log2(c.n)) as string)), "
        "'random', c.z_chi <= {z} AND c.z_runs <= {z} AND c.z_serial <= {z}, "
        "'bin', CASE WHEN c.pairs >= c.expected THEN 0 ELSE cast(floor(10 / ln(10) * (c.expected - c.pairs "
        "+ if(c.pairs > 0, c.pairs * ln(c.pairs / c.expected), 0D))) as int) END".replace("{z}", f"{z_limit}D")))
    return df


def discovery_bins(tokens: DataFrame, fdr: float) -> dict[str, int]:
    """Least bin per stratum that Benjamini-Hochberg accepts; strata without discoveries are absent.

    ``tokens``: one row per distinct token (stratum, bin). The result has at
    most one entry per encoding and length class: a few hundred.
    """
    counts = tokens.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = counts.withColumn("k", F.sum("n").over(down)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("stratum")))
    ok = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") / F.col("k") <= F.lit(fdr)
    return {r["stratum"]: r["bin"] for r in ranked.where(ok).groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def scan_secrets(docs: DataFrame, min_length: int = 20, z_limit: float = 3.4, fdr: float = 0.01,
                 keep: tuple = ()) -> DataFrame:
    """``doc_id, base, added, text_hash`` per row of ``docs``.

    ``base`` and ``added`` are arrays of (start, ord, kind, end), in order of
    start, then kind; positions count code points, the end is exclusive.
    An added span never overlaps a base span and lies in no other added span.
    A null text is the empty text
    and has no spans; texts of any length are scanned whole; repeated rows
    have equal results; equal tokens count once for the discovery rule. An
    empty table gives an empty result. Extra columns are ignored unless
    named in ``keep``.
    """
    df = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_of().alias("_text"),
                     *[F.col(c).alias(f"_keep_{c}") for c in keep])
    value = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    df = _find(df, "assign", ASSIGN, f"length(regexp_extract(x.m, '{value}', 1)) >= 6")
    df = _find(df, "access", ACCESS, "length(x.m) >= 20")
    df = _find(df, "hex", LONG_HEX, "true")
    runs = [f"cands{i}" for i in range(len(TOKEN_CHARS))]
    for name, chars in zip(runs, TOKEN_CHARS):
        df = _find(df, name, f"{chars}{{{max(1, int(min_length) - PADDING)},}}=*",
                   f"length(x.m) >= {int(min_length)} AND rlike(x.m, '[0-9]') AND rlike(x.m, '[A-Za-z]')")
    # a run may be found over several sets of characters: once is enough
    df = df.withColumn("cands", F.array_sort(F.concat(*runs))).drop(*runs)
    df = df.withColumn("cands", F.expr("filter(cands, (c, i) -> i = 0 OR c != cands[i - 1])"))
    # the last span of a kind that starts before a run's end reaches farthest: if it ends before the run, all do
    clear = " AND ".join(f"(size({k}) = 0 OR coalesce(get({k}, {_count_before(k, 'c.end')} - 1).end, 0) <= c.start)" for k in BASE_KINDS)
    df = df.withColumn("cands", F.expr(f"filter(cands, c -> {clear})"))
    spans = F.concat(*[F.expr(f"transform({k}, x -> named_struct('start', x.start, 'ord', {i}, 'kind', '{k}', 'end', x.end))")
                       for i, k in enumerate(BASE_KINDS)])
    df = df.withColumn("base", F.array_sort(spans)).drop(*BASE_KINDS, "_text")
    df = materialize(_battery(df, "cands", z_limit), "scored")
    tokens = df.select(F.explode("cands").alias("c")).select("c.stratum", "c.bin", "c.id").distinct()
    accepted = discovery_bins(tokens, fdr)
    least = F.create_map(*[F.lit(x) for kv in accepted.items() for x in kv]) if accepted else \
        F.expr("cast(map() as map<string,int>)")
    df = df.withColumn("_least", least)
    # of accepted runs within one another the outermost stays: by start, longest first, a run is within an
    # earlier one if any of those ends as late
    chosen = F.expr("array_sort(transform(filter(cands, c -> c.random AND c.bin >= coalesce(_least[c.stratum], 2147483647)), "
                    "c -> named_struct('start', c.start, 'back', -c.end)))")
    before = f"slice(concat(array(0), {_scan('transform(chosen, x -> -x.back)', 'greatest({x}, {y})')}), 1, size(chosen))"
    added = F.expr(f"""transform(filter(zip_with(chosen, {before}, (x, reach) -> named_struct('x', x, 'reach', reach)), z -> z.reach < -z.x.back),
        z -> named_struct('start', z.x.start, 'ord', {len(BASE_KINDS)}, 'kind', '{ADDED_KIND}', 'end', -z.x.back))""")
    df = df.withColumn("chosen", chosen)
    return df.withColumn("added", added).select(
        "doc_id", "text_hash", "base", "added", *[F.col(f"_keep_{c}").alias(c) for c in keep])


def span_text(spans) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **params) -> DataFrame:
    """Counts, digest of the base spans and all spans, one row per document row."""
    df = scan_secrets(docs, **params)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))
