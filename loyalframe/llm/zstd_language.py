"""Language identification by compression.

For each language a raw-content dictionary is filled with labelled texts,
of long ones an excerpt. A text is compressed with every language's dictionary; the smallest
output names the language, as its letter sequences were found in that
dictionary most often. A text is compressed in chunks of ``CHUNK`` bytes, each
with the dictionary alone, and the sizes are summed: in one go the text itself
would soon replace the dictionary, and the margin would fall with the length.
The margin to the second best, in compressed bytes per hundred, is the
confidence; a text with a narrow margin is rejected.

Learning reads labels once: rows are ordered by a hash, the first
``sample_rows`` of each language are the sample, and their texts are taken in
that order while they fit into ``dict_bytes``. Of a text above a quarter of
``dict_bytes`` the middle is taken, a sixteenth of ``dict_bytes`` in
characters, so a language with long texts only is learned too. The driver holds
at most (``dict_bytes`` plus the sample's ids) per language, at any size of
the table. Letters are taken in lower case. Between languages of equal size
the one with more labelled rows is taken.
"""

from __future__ import annotations

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import slim, unkept, with_text_columns

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
CHUNK = 1 << 14  # bytes, a quarter of a dictionary


def learn(labelled: DataFrame, dict_bytes: int = 1 << 16, sample_rows: int = 200) -> dict[str, bytes]:
    """Dictionary content per language from ``labelled`` (doc_id, text, lang), the commonest language first.

    A bounded sample: ``dict_bytes`` and ``sample_rows`` per language; long
    texts are cut for learning only. Every language with a labelled text has
    content. Rows without language or text are not learned from.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0")
    order = F.xxhash64("doc_id")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = rows.select("lang", "doc_id", order.alias("h")).withColumn("r", first).where(
        F.col("r") <= sample_rows).select("doc_id").distinct().collect()  # sample_rows per language
    sample = rows.where(F.col("doc_id").isin([r[0] for r in ids])) if ids else rows.limit(0)
    part = max(1, dict_bytes // 16)  # characters, of up to four bytes each
    middle = F.substring("text", F.greatest(F.lit(1), ((F.length("text") - part) / 2).cast("int")), F.lit(part))
    sample = sample.withColumn("text", F.when(F.octet_length("text") > dict_bytes // 4, middle).otherwise(F.col("text")))
    size = F.octet_length("text")  # the sum of sizes decides which fit
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    sample = sample.select("lang", "doc_id", "text", order.alias("h"), size.alias("size")).withColumn("upto", upto).where(
        F.col("upto") <= dict_bytes)
    counts = rows.groupBy("lang").count().collect() if ids else []  # one row per language
    content: dict[str, bytes] = {r["lang"]: b"" for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], -r["h"], r["doc_id"], r["text"])):
        content[r["lang"]] += r["text"].lower().encode() + b"\n"
    return content


def compressors(content: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang in content:
        if not content[lang]:
            continue
        d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, ready: list) -> tuple[str, float, float]:
    """(language, score, margin): smallest output, ties to the language that was learned first."""
    if not ready or text is None or LETTER.search(text) is None:
        return UNKNOWN, 0.0, 0.0
    data = memoryview(text.lower().encode())
    chunks = [data[at:at + CHUNK] for at in range(0, len(data), CHUNK)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), turn) for turn, (_, c) in enumerate(ready))
    lang = ready[sizes[0][1]][0]
    if len(sizes) == 1:
        return lang, 1.0, 1.0
    margin = 1.0 - sizes[0][0] / sizes[1][0]
    return lang, 0.5 + 0.5 * min(1.0, 4 * margin), margin


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = 0.001, level: int = 6,
             keep: tuple = ()) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` and the columns of ``keep`` for every row.

    Whole texts are compressed, whatever their length, in chunks. A null text, one
    without a letter, or no learned language gives ``und`` with score 0,
    rejected. Ties go to the language with more labelled rows, with margin 0,
    so they are rejected. Repeated rows have equal results, an empty table gives an
    empty result. Extra columns are ignored unless named in ``keep``; the
    prediction reads the text alone.
    """
    def make():
        ready = compressors(content, level)

        def columns(texts: list) -> tuple:
            found = [classify(t, ready) for t in texts]
            langs, scores, margins = map(list, zip(*found)) if found else ([], [], [])
            return langs, scores, margins, [g == UNKNOWN or m < min_margin for g, m in zip(langs, margins)]

        return columns

    done = with_text_columns(slim(docs, tuple(c for c in keep if c != "text")), "lang_pred string, score double, margin double, rejected boolean",
                             make, again="_keep_text" if "text" in keep else None)
    return done.select("doc_id", "lang_pred", "score", "margin", "rejected", *unkept(keep))


def held_out() -> Column:
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame, **params) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row of ``docs``."""
    content = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, content, **params).withColumn("held_out", held_out())
