"""The corpus pipeline against brute force, and its queries' registration."""

import hashlib
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as E
    from loyalframe.llm.queries import QUERIES, SQL

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ["op1_vafile_topk", "op4_systematic_mixture", "op6_trie_jaccard", "op8_block_knn",
                                  "op11_diagonal_licenses", "op12_four_russians", "op13_bloom_variants"])
def test_query_matches_sql(spark, name):
    import duckdb

    from loyalframe.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cur.fetchall())


def test_stages(spark):
    import corpus_pipeline as C
    from tests.llm.test_operators import odd_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    kept = kept.cache()
    single = C.near_duplicates(spark, kept, SF).cache()
    classes = five_word_classes([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in single.collect()} == set(classes.values()) and single.columns == docs.columns
    clean = C.personal_data(spark, single, SF).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not clean.where("text rlike '[a-z0-9.]+@mail[0-9][.]example'").count()
    mixed = C.mixture(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and set(mixed.select("doc_id").distinct().collect()) <= set(clean.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = C.encoding(spark, mixed, SF).collect()
    assert len(out) == mixed.count()
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens == len(r.ids)
    odd = odd_documents(spark).select(*docs.columns)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == docs.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert Counter(r.doc_id for r in C.near_duplicates(spark, odd, SF).collect()) == Counter([1, 2, 3, None, 5, 6, 8])


def five_word_classes(rows, n=5, percent=80):
    """Least id of each id's class under chains of links, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[a:a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


def test_near_duplicates_take_five_words_and_four_fifths(spark):
    import corpus_pipeline as C
    from tests.llm.test_operators import DOC, near_copies

    base = [f"w{i}" for i in range(200)]
    longer = base + [f"x{i}" for i in range(36)]  # 18 % of contiguous text more
    changed = base[:100] + [f"y{i}" for i in range(14)] + base[114:]  # 7 % replaced
    far = base[:100] + [f"z{i}" for i in range(40)] + base[140:]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, longer, changed, far))] + near_copies(spark)
    kept = {r.doc_id for r in C.near_duplicates(spark, spark.createDataFrame(rows, DOC), SF).collect()}
    assert kept == set(five_word_classes([r[:2] for r in rows]).values()) and {0, 3} <= kept and not {1, 2} & kept


def test_near_duplicates_of_the_table(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    single = C.near_duplicates(spark, docs, SF)
    want = set(five_word_classes([(r.doc_id, r.text) for r in docs.collect()]).values())
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(want)


def test_near_duplicates_keep_different_texts_under_one_id(spark):
    import corpus_pipeline as C
    from tests.llm.test_operators import DOC

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, text["a"], "en", "s", 1), (1, text["b"], "en", "s", 1), (2, text["a"] + " end", "en", "s", 1),
            (3, text["b"] + " end", "en", "s", 1), (4, text["c"], "fr", "t", 1), (4, text["c"], "de", "t", 1),
            (5, text["d"], "en", "s", 1), (None, text["d"], "en", "s", 1), (6, None, "en", "s", 1), (6, "", "en", "s", 1)]
    kept = C.near_duplicates(spark, spark.createDataFrame(rows, DOC), SF)
    want = [(1, text["a"], "en"), (1, text["b"], "en"), (4, text["c"], "de"), (5, text["d"], "en"), (None, text["d"], "en"),
            (6, None, "en"), (6, "", "en")]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text, r.lang) for r in kept.collect()) == Counter(want)
