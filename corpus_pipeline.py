"""From raw documents to token ids: language, near duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet to the shared folder and read again as the next stage's
input, so a lost executor never sends the run back to the first stage. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalframe.llm.byte_bpe import tokenise
from loyalframe.llm.common import materialize, table
from loyalframe.llm.mixing import mix
from loyalframe.llm.ngram_trie_join import jaccard_classes
from loyalframe.llm.pii_bootstrap import mask_personal_data
from loyalframe.llm.zstd_language import held_out, identify, learn

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: near duplicates: Jaccard similarity of 0.8 or more on shingles of five words (op6 has its own contract, 3 and 90)
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identification rejects go; a missing ``lang`` is filled in."""
    content = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = identify(docs, content, keep=others).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group stays: the one with the smallest doc_id, then the smallest hash.

    Rows equal in doc_id and text become one, the least in its other columns;
    different texts under one doc_id are documents of their own. Rows without
    doc_id all stay.
    """
    def text_hash() -> Column:
        return F.xxhash64(F.col("text").isNull(), "text")

    named = docs.where("doc_id IS NOT NULL")
    again = materialize(named.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(text_hash()).alias("low"), F.max(text_hash()).alias("high")).where("n > 1"), "again")
    if again.where("low != high").isEmpty():
        classes = jaccard_classes(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
        gone = materialize(classes.where("doc_id != component_id").select("doc_id").distinct(), "gone")
        kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    else:  # ids that clash: each (doc_id, text) has a node number in the place of its id
        keys = named.select("doc_id", text_hash().alias("_hash")).distinct()
        keys = materialize(keys.withColumn("node", F.monotonically_increasing_id()), "keys")
        nodes = named.select("doc_id", "text", text_hash().alias("_hash")).join(keys, ["doc_id", "_hash"])
        nodes = materialize(nodes.select(F.col("node").alias("doc_id"), "text"), "nodes")
        classes = jaccard_classes(nodes, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
        linked = keys.join(classes.select(F.col("doc_id").alias("node"), "component_id").distinct(), "node")
        least = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "_hash")).alias("least"))
        gone = linked.join(least, "component_id").where(F.struct("doc_id", "_hash") != F.col("least"))
        gone = materialize(gone.select("doc_id", "_hash"), "gone")
        kept = docs.withColumn("_hash", text_hash()).join(gone, ["doc_id", "_hash"], "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    again = again.select("doc_id")
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", text_hash().alias("_hash")).agg(
        F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, as in ``<EMAIL>``; ``n_chars`` follows the text."""
    masked = mask_personal_data(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of ids and decoded bytes, one row per document."""
    return tokenise(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True,
                    keep=("lang", "source"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: compression sizes and merges of a vocabulary are not expressions of SQL: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
