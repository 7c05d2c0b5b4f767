"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalframe.llm.block_knn import nearest
from loyalframe.llm.byte_bpe import tokenise
from loyalframe.llm.common import table
from loyalframe.llm.hard_negatives import hard_negatives
from loyalframe.llm.license_scan import NOTICES, PHRASES, license_report
from loyalframe.llm.mixing import mixture
from loyalframe.llm.ngram_trie_join import jaccard_classes
from loyalframe.llm.pii_bootstrap import pii_report
from loyalframe.llm.randomness_secrets import secret_report
from loyalframe.llm.separator_scan import count_tokens
from loyalframe.llm.spelling_variants import spelling_variants
from loyalframe.llm.url_rules import judge_urls
from loyalframe.llm.vafile_topk import exact_top_k
from loyalframe.llm.zstd_language import identify_documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "closed")


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op4_systematic_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op11_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op12_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, scale=256, low=50, high=95)


def op13_bloom_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_vafile_topk, op2_separator_scan, op3_bootstrapped_pii, op4_systematic_mixture, op5_byte_bpe,
        op6_trie_jaccard, op7_url_rules, op8_block_knn, op9_zstd_language, op10_randomness_secrets, op11_diagonal_licenses, op12_four_russians,
        op13_bloom_variants)
}

_VECTORS = """
v AS (SELECT DISTINCT vec_id, {vector} AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 {more})"""

_QUOTED = lambda t: "'" + t.replace("'", "''") + "'"
_TEMPLATES = ", ".join(f"({i}, {exact}, {_QUOTED(label)}, {_QUOTED(text)})" for i, (exact, label, text) in enumerate(
    [*[("true", *p) for p in PHRASES], *[("false", *n) for n in NOTICES]]))

SQL: dict[str, str] = {
    "op1_vafile_topk": f"""
WITH {_VECTORS.format(vector="[floor(64 * x::DOUBLE) FOR x IN embedding]", more="")},
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20""",
    "op8_block_knn": f"""
WITH {_VECTORS.format(vector="embedding::DOUBLE[]", more="AND len([x FOR x IN embedding IF x <> 0]) > 0")},
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10""",
    # votes by equal words instead of hashes
    "op11_diagonal_licenses": r"""
WITH v(template, exact, label, text) AS (VALUES {templates}),
m AS (SELECT template, exact, label, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS tw FROM v),
d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT row, d, w[d + 1] AS a, w[d + 2] AS b, w[d + 3] AS c FROM (SELECT row, w, unnest(range(0, len(w) - 2)) AS d FROM d WHERE len(w) > 2)),
g AS (SELECT template, t, tw[t + 1] AS a, tw[t + 2] AS b, tw[t + 3] AS c FROM (SELECT template, tw, unnest(range(0, len(tw) - 2)) AS t FROM m)),
h AS (SELECT row, template, d - t AS diagonal, count(*) AS votes FROM e JOIN g USING (a, b, c) GROUP BY ALL),
s AS (SELECT h.*, exact, CASE WHEN exact OR diagonal - lag(diagonal) OVER o <= 8 THEN exact::INTEGER ELSE 1 END AS apart
      FROM h JOIN m USING (template) WHERE CASE WHEN exact THEN votes = len(tw) - 2 ELSE votes >= least(3, len(tw) - 2) END
      WINDOW o AS (PARTITION BY row, template ORDER BY diagonal)),
u AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM s),
x AS (SELECT u.row, u.template, u.span, m.exact, m.label, len(m.tw) AS size, g.t, e.d, unnest([0, 1, 2]) AS more
      FROM u JOIN m USING (template) JOIN g USING (template) JOIN e ON e.row = u.row AND e.a = g.a AND e.b = g.b AND e.c = g.c AND e.d - g.t = u.diagonal),
o AS (SELECT row, exact, label, min(d) AS start, max(d) + 3 AS stop, count(DISTINCT t + more)::DOUBLE / size AS score
      FROM x GROUP BY row, template, span, exact, label, size
      HAVING exact OR (count(DISTINCT t + more)::DOUBLE / size >= 0.75 AND max(d) + 3 - min(d) <= 2 * size)),
i AS (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY row, exact ORDER BY start, stop, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start
                THEN 0 ELSE 1 END AS apart FROM o),
j AS (SELECT *, sum(apart) OVER (PARTITION BY row, exact ORDER BY start, stop, label ROWS UNBOUNDED PRECEDING) AS island FROM i),
y AS (SELECT * FROM j QUALIFY score = max(score) OVER (PARTITION BY row, exact, island)),
z AS (SELECT row, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
             array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (exact), []))), ',') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM y GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score FROM d LEFT JOIN z USING (row)""".replace("{templates}", _TEMPLATES),
    "op12_four_russians": f"""
WITH {_VECTORS.format(vector="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding]",
                      more="AND label IS NOT NULL AND vec_id IS NOT NULL")},
n AS (SELECT *, row_number() OVER () AS row FROM v),
p AS (SELECT q.row, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM p WHERE same),
m AS (SELECT s.anchor_id, s.vec_id AS positive_id, p.vec_id AS negative_id, s.score AS positive_score, p.score AS negative_score,
             (row_number() OVER (PARTITION BY s.row, s.place ORDER BY p.score DESC, p.vec_id))::INTEGER AS rank
      FROM s JOIN p ON p.row = s.row AND NOT p.same AND 50 * s.score <= 100 * p.score AND 100 * p.score <= 95 * s.score
      WHERE s.place <= 5)
SELECT * FROM m WHERE rank <= 3""",
    # the checksum bit by bit: a zero after each byte's first of eight steps; near words by wildcard and by deletion
    "op13_bloom_variants": r"""
WITH RECURSIVE
o AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM o GROUP BY id, run),
x AS (SELECT *, hex(encode(id || run)) AS x FROM g),
c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(
        [[('0x' || substr(x, i::INTEGER, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR i IN range(1, len(x), 2)])),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS h FROM x),
r AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w),
s AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS t FROM k),
d AS (SELECT DISTINCT word, n, l || t AS cut FROM s),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM s a JOIN s b ON a.i = b.i AND a.l = b.l AND a.t = b.t AND a.word <> b.word
      UNION ALL SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.cut
      UNION ALL SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.cut),
f AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS top, max(other_n) AS top_n FROM p GROUP BY word, n),
e AS (SELECT word, n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM f),
z AS (SELECT word, word AS root, 0 AS depth FROM w
      UNION ALL SELECT z.word, e.form, z.depth + 1 FROM z JOIN e ON e.word = z.root WHERE e.form IS NOT NULL)
SELECT w.word, e.form, arg_max(z.root, z.depth) AS root, w.n, coalesce(e.n_near, 0) AS n_near, e.form_n
FROM w LEFT JOIN e USING (word) JOIN z ON z.word = w.word GROUP BY w.word, e.form, w.n, e.n_near, e.form_n""",
    # the same sampling design: size bins, parts by the MD5 of the id, one offset per source
    "op4_systematic_mixture": r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS s,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 16 + ((size * 16) >> (length(bin(size)) - 1)) END AS bin FROM d),
src AS (SELECT s, source, sum(size)::BIGINT AS source_size FROM b GROUP BY s, source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap FROM src),
o AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
      FROM w),
l AS (SELECT (total - cap_before) / w_left AS level FROM o
      WHERE (total - cap_before) / w_left <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT s, source_size, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target FROM o),
g AS (SELECT s, bin, ceil(count(*) / 4096)::BIGINT AS parts FROM b GROUP BY s, bin),
p AS (SELECT b.*, t.source_size, t.target,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % parts AS part
      FROM b JOIN g USING (s, bin) JOIN t USING (s)),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY bin, part, size, doc_id) AS pos,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('7:' || s), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM p)
SELECT doc_id, size, source_size, target,
       (floor(pos * rate + u) - floor((pos - 1) * rate + u))::BIGINT * size AS taken FROM n""",
    "op6_trie_jaccard": r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM d),
k AS (SELECT doc_id, list_sort(g) AS g, len(g) AS n FROM s),
c AS (SELECT g, n, min(doc_id) AS rep FROM k WHERE n > 0 GROUP BY g, n),
t AS (SELECT rep, n, unnest(g) AS x FROM c),
e AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep AND b.n * 100 >= 90 * a.n AND a.n * 100 >= 90 * b.n
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT rep, rep AS reached FROM c UNION SELECT r.rep, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT rep, min(reached) AS component_id FROM r GROUP BY rep)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id
FROM k LEFT JOIN c ON k.g = c.g AND k.n > 0 LEFT JOIN m ON m.rep = c.rep""",
}
