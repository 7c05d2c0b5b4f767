"""Personal data by exact patterns and bootstrapped context.

The exact patterns find the base spans; they are also the seeds of the
bootstrap. Every mention of something like an identifier (a seed, a token
with an ``@`` or ``min_digits`` digits, or digit groups joined by blanks and
other signs with so many digits in all) has lexical patterns: the word
before it, the two words before it, the words on both sides. Mentions and
patterns form a bipartite graph, one edge per distinct (identifier,
pattern), so that copies of a text count once. Each round scores the
patterns by the share of their identifiers that are known (smoothed, with a
least support) and the unknown identifiers by the patterns that hold them
(noisy or), all as Spark aggregates and joins; what was found feeds the next
round. Unknown identifiers above ``accept`` are added where they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, python_workers, slices, text_of, with_text_columns

KINDS = ("email", "ip", "card", "phone")
# fixed values: the exact patterns, in forms that take linear time on long runs. A domain and an IP's
# first part are tried once per run: a later start in the same run meets the same end
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ITEM = 100  # characters; of a longer identifier the graph holds the digest
DIGIT = re.compile(r"[0-9]")
MENTION = re.compile(r"[0-9@]\S*+")
# digit groups joined by one blank, dot, dash or slash, or by a parenthesis with or without one
GROUPS = re.compile(r"(?<![0-9])[0-9]++(?:(?:\)?[\x20\xa0./-]|[\x20\xa0./-]?\(|\))[0-9]++)++")
EDGES = ".,;:!?()[]{}<>\"'|*#&%$"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end = max(end, at)  # what stands before this @ starts no later match
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
        out.sort()
    return out


def group_runs(text: str, base: list, min_digits: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of digit groups with a blank inside, between the spans of ``base``.

    A plus sign or an opening parenthesis before a run, or up to four letters
    as in ``DE89 3704``, belong to it.
    """
    out, at = [], 0
    for stop, after in [(s, e) for s, _, e in base] + [(len(text), len(text))]:
        for m in GROUPS.finditer(text, at, max(at, stop)):
            a, b = m.span()
            if not (" " in m[0] or "\xa0" in m[0]) or len(DIGIT.findall(m[0])) < min_digits:
                continue
            letters = a
            while letters > max(at, a - 5) and text[letters - 1].isalpha():
                letters -= 1
            if a - letters <= 4:
                a = letters
            if a > at and (text[a - 1] == "+" or text[a - 1] == "(" and ")" in m[0]):
                a -= 1
            out.append((a, b))
        at = max(at, after)
    return out


def mentions(text: str, base: list, min_digits: int, max_length: int | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number or -1, end) of the seeds, of other tokens that look like identifiers and of runs of digit groups."""
    out, end, k = list(base), 0, 0
    limit = len(text) if max_length is None else max_length
    out += [(a, -1, b) for a, b in group_runs(text, base, min_digits) if b - a <= limit] if DIGIT.search(text) else []
    for m in MENTION.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        token = text[start:end] if end - start <= 4 * limit else ""
        a = start + len(token) - len(token.lstrip(EDGES))
        b = a + len(token.strip(EDGES))
        if not 0 < b - a <= limit:
            continue
        if "@" not in text[a:b] and len(DIGIT.findall(text, a, b)) < min_digits:
            continue
        while k < len(base) and base[k][2] <= a and base[k][0] < a:
            k += 1
        if not any(s < b and a < e for s, _, e in base[max(0, k - 4):k + 4]):
            out.append((a, -1, b))
    return out


def contexts(text: str, start: int, end: int, symbol: str) -> list[str]:
    before = text[max(0, start - 80):start].lower().split()[-2:]
    after = text[end:end + 80].lower().split()[:1]
    out = []
    if before:
        out.append(f"{symbol}|l|{before[-1]}")
        if len(before) == 2:
            out.append(f"{symbol}|ll|{before[0]} {before[1]}")
        if after:
            out.append(f"{symbol}|lr|{before[-1]} _ {after[0]}")
    return out


_SCAN = ("base array<struct<start:int,ord:int,kind:string,end:int>>, "
         "mentions array<struct<start:int,end:int,kind:string,item:string,patterns:array<string>>>")


def scan(docs: DataFrame, min_digits: int, max_length: int | None) -> DataFrame:
    """``doc_id, text_hash, base, mentions`` per row."""
    def make():
        def columns(texts: list) -> tuple:
            spans, found = [], []
            for text in texts:
                base = base_spans(text)
                spans.append([{"start": s, "ord": k, "kind": KINDS[k], "end": e} for s, k, e in base])
                found.append([{
                    "start": s, "end": e, "kind": KINDS[k] if k >= 0 else None, "item": text[s:e] if e - s <= ITEM else hashlib.sha256(text[s:e].encode()).hexdigest(),
                    "patterns": contexts(text, s, e, "@" if "@" in text[s:e] else "9"),
                } for s, k, e in mentions(text, base, min_digits, max_length)])
            return spans, found

        return columns

    return with_text_columns(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_of().alias("_text")),
                             _SCAN, make)


def bootstrap(graph: DataFrame, rounds: int = 3, min_support: int = 5, min_confidence: float = 0.7,
              accept: float = 0.9, smooth: float = 2.0) -> DataFrame:
    """Accepted unknown identifiers ``item, kind, score`` of ``graph`` (item, kind or null, pattern).

    Round by round: pattern confidence = known score of its identifiers /
    (all its identifiers + ``smooth``); identifier score = 1 - product of
    (1 - confidence) over its good patterns, for its best kind. Ties between
    kinds go to the first by name. An item known under two kinds counts for
    both.
    """
    edges = materialize(graph.distinct(), "edges")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= min_support)
    sizes = materialize(sizes, "sizes")
    seeds = edges.where("kind IS NOT NULL").select("item", "kind", "pattern", F.lit(1.0).alias("score"))
    open_ = edges.where("kind IS NULL").select("item", "pattern")
    known, found = seeds, None
    for turn in range(rounds):
        held = known.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("support"))
        confidence = F.col("s") / (F.col("n") + F.lit(smooth))
        good = held.join(sizes, "pattern").withColumn("c", confidence).where(
            (F.col("support") >= min_support) & (F.col("c") >= min_confidence)).select("pattern", "kind", "c")
        good = materialize(good, f"patterns{turn}")
        scored = open_.join(good, "pattern").groupBy("item", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("score"))
        best = scored.groupBy("item").agg(F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), "kind")).alias("b"))
        found = materialize(best.select("item", "b.kind", "b.score"), f"found{turn}")
        if turn + 1 < rounds:
            if found.isEmpty():
                break
            known = seeds.unionByName(open_.join(found, "item").select("item", "kind", "pattern", "score"))
    return found.where(F.col("score") >= accept)


def find_personal_data(docs: DataFrame, min_digits: int = 5, max_length: int | None = None, **params) -> DataFrame:
    """``doc_id, text_hash, base, added`` for every row of ``docs``.

    Both are arrays of (start, ord, kind, end) in order of start, then kind;
    positions count code points, the end is exclusive. Added spans overlap no
    base span. A null text is the empty text; texts of any length are scanned
    whole, in linear time; repeated rows have equal results and count once in
    the graph; an empty table gives an empty result; extra columns are
    ignored. An identifier that the bootstrap may add has any length, or at
    most ``max_length`` characters if that is given.
    """
    rows = materialize(scan(docs, min_digits, max_length).withColumn("row", F.monotonically_increasing_id()), "scan")
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    accepted = bootstrap(each.select("item", "kind", F.explode("patterns").alias("pattern")), **params)
    hits = each.where("kind IS NULL").select("row", "start", "end", "item").join(accepted.select("item", "kind"), "item")
    # a token of an accepted run of digit groups is no span of its own
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("until", F.max("end").over(before)).where("until IS NULL OR end > until")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    added = hits.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", number.alias("ord"), "kind", "end"))).alias("added"))
    out = rows.join(materialize(added, "added"), "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")
    return out.select("doc_id", "text_hash", "base", F.coalesce("added", none).alias("added"))


def span_text(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, **params) -> DataFrame:
    """Counts, digest of the base spans and all spans, one row per document row."""
    df = find_personal_data(docs, **params)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with its spans as ``<KIND>``; overlapping spans become one, of the first one's kind."""
    out, at, until = [], 0, -1
    for start, end, kind in sorted(spans):
        if start < until:
            until = at = max(until, end)
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = until = end
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (a null text stays null); all columns stay.

    The added spans of a text are looked up by doc_id and text; base spans
    are found again while masking, so only rows with added spans are joined.
    """
    found = find_personal_data(docs, **params).where(F.size("added") > 0).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("added").alias("_added")).distinct()
    found = materialize(found, "masks")
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"])
    joined = docs.join(found, same, "left").drop("_id", "_hash")
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, added in zip(batch.column("text").to_pylist(), batch.column("_added").to_pylist()):
                if text is not None:
                    spans = [(s, e, KINDS[k]) for s, k, e in base_spans(text)]
                    spans += [(a["start"], a["end"], a["kind"]) for a in added or ()]
                    text = masked(text, spans) if spans else text
                out.append(text)
            rest = batch.drop_columns(["_added"])
            at = rest.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(rest.columns)], names=rest.schema.names)

    return joined.mapInArrow(run, docs.schema)
