"""URL filters: fixed host and path rules, then association rules mined from labelled URLs.

A URL is broken into tokens (scheme, host labels, all folders, file extension,
query keys, key=value pairs, ...). URLs that a fixed rule judges are the
labelled transactions; association rules are token combinations that come
with a verdict, pruned by support and confidence. Single tokens below that
support, such as one host of many, are counted and need a number of labelled
URLs instead of a share; no combination of such tokens can reach the support.
Combinations are searched level by level over all other tokens, and only
branches that hold no rule, or none that could win, are left out
(:func:`mine_combinations`). URLs that no fixed rule fits are judged by the mined rules,
matched by an inverted index: the token sets that occur are joined to the
rules on a rule's rarest token, and a rule fires when all its tokens are
found. URLs with equal token sets are matched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize

ALLOW, BLOCK = "allow", "block"
# fixed values: verdict, host, path
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "verdict="
#: 64-bit words of a block of labelled URLs, one bit per URL
WORDS = 8


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty for a null URL or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    df = df.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    after = F.expr("substring(_rest, length(_host) + 1)")
    return df.withColumn("host", F.translate("_host", UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(after, r"^[^?#]*", 0)).drop("_rest", "_host")


def fixed_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits ``host`` and ``path``; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def url_tokens(url: str = "url") -> Column:
    """Sorted distinct tokens of a URL, from ``url``, ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    folders = F.filter(F.split("path", "/"), lambda x: x != "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    pairs = F.split(query, "&")
    keys = F.filter(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    valued = F.filter(pairs, lambda x: x.rlike("^[^=]+=."))
    one = lambda c, name: F.when(c, F.array(name if isinstance(name, Column) else F.lit(name))).otherwise(F.array().cast("array<string>"))
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.array_sort(F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme="), F.substring_index(u, "://", 1))),
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(folders, lambda x: F.concat(F.lit("folder="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key="), x)),
        F.transform(valued, lambda x: F.concat(F.lit("query="), x)),
        one(extension != "", F.concat(F.lit("extension="), extension)),
        one(F.col("path").endswith("/"), "ends=/"),
        one(F.contains(u, F.lit("#")), "fragment"),
    )))


def combined_tokens(counts: DataFrame, total: int, min_support: float, common_share: float, width: int) -> list[str]:
    """The ``width`` tokens most associated with a verdict, of those that combinations may be made of.

    ``counts``: one row per token with n, h (a hash of the URLs that have it)
    and the URLs per verdict. Tokens below ``min_support`` or above
    ``common_share`` are no part of combinations, nor are tokens that always
    come together with one that stays. Association is the chi-squared
    statistic of the token against the verdict; ties go to the first in
    code-point order.
    """
    frequent = counts.where((F.col("n") >= min_support * total) & (F.col("n") <= common_share * total))
    same = frequent.groupBy("n", "h").agg(F.min("t").alias("t"), F.first(BLOCK).alias(BLOCK), F.first("all_block").alias("all_block"))
    base = F.col("all_block") / F.lit(float(max(total, 1)))
    chi = (F.col(BLOCK) - F.col("n") * base) ** 2 / (F.col("n") * F.greatest(base * (1 - base), F.lit(1e-12)))
    return [r["t"] for r in same.orderBy(chi.desc(), "t").limit(width).collect()]


def token_bits(labelled: DataFrame, names: DataFrame) -> DataFrame:
    """``block, x, b0, b1, ...``: which URLs of a block have token ``x`` of ``names`` (t, x); even blocks are allowed URLs, odd ones blocked."""
    size = 64 * WORDS
    rows = labelled.withColumn("id", F.monotonically_increasing_id()).select(
        (F.expr(f"id div {size}") * 2 + (F.col("verdict") == BLOCK).cast("long")).alias("block"),
        (F.col("id") % size).alias("bit"), F.explode("tokens").alias("t"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = [F.coalesce(F.bit_or(F.when(F.expr("bit div 64") == k, one)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(WORDS)]
    return rows.join(F.broadcast(names), "t").groupBy("block", "x").agg(*words)


def mine_combinations(labelled: DataFrame, counts: DataFrame, total: int, min_support: float, min_confidence: float,
                      common_share: float) -> DataFrame:
    """``tokens, verdict, confidence, support`` of combinations of two or more tokens, of any tokens and any number of them.

    Left out are only combinations that cannot judge a URL: one whose subset
    has the same labelled URLs, or comes with one verdict only, is beaten by
    that subset wherever it fires (at least the same confidence and support,
    fewer tokens). Sets of tokens that more than ``common_share`` of the
    labelled URLs have are no rules, but parts of larger ones.

    A node is a set of tokens and the later tokens that may join it; tokens
    are in order of their number of URLs. Each level counts all nodes with
    each such token, by the common bits of node and token in blocks of URLs
    (:func:`token_bits`). A node is dropped when none of its supersets can
    reach the confidence: tokens that join take away from the other verdict
    no more than the sum of what each takes alone. What remains is
    exponential in the worst case, in time and in the size of a level; rows
    are small and dealt over all tasks.
    """
    spark, least = labelled.sparkSession, min_support * total
    pure = (F.col(ALLOW) == 0) | (F.col(BLOCK) == 0)
    rare_enough = F.col(ALLOW) + F.col(BLOCK) <= common_share * total
    joins = (F.greatest(ALLOW, BLOCK) >= least) & (F.col(ALLOW) + F.col(BLOCK) < F.col("n")) & ~(pure & rare_enough)
    root = counts.select("t", ALLOW, BLOCK).withColumn("n", F.lit(total)).where(joins)
    # at most (tokens of a URL) / min_support of them, whatever the number of URLs
    first = root.orderBy(F.col(ALLOW) + F.col(BLOCK), "t").collect()
    names = [r["t"] for r in first]
    none = spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    if len(names) < 2:
        return none
    known = F.array(*[F.lit(t) for t in names])
    bits = materialize(token_bits(labelled, spark.createDataFrame(list(zip(names, range(len(names)))), "t string, x int")), "bits")
    blocked = counts.first()["all_block"]
    counted = spark.createDataFrame(
        [(0, [], total - blocked, blocked, i, r[ALLOW], r[BLOCK]) for i, r in enumerate(first)],
        f"node long, items array<int>, n_{ALLOW} long, n_{BLOCK} long, x int, {ALLOW} long, {BLOCK} long")
    words, found, node_bits = range(WORDS), [], None
    later = Window.partitionBy("node").orderBy("x").rowsBetween(1, Window.unboundedFollowing)
    while True:
        # what tokens that join later may take from the other verdict, at most
        taken = {v: F.coalesce(F.sum(F.when(F.col(v) >= least, F.col(f"n_{w}") - F.col(w))).over(later), F.lit(0))
                 for v, w in ((ALLOW, BLOCK), (BLOCK, ALLOW))}
        nodes = counted.withColumn("n", F.col(f"n_{ALLOW}") + F.col(f"n_{BLOCK}")).where(joins)
        nodes = nodes.select("node", "items", "x", ALLOW, BLOCK, F.collect_list("x").over(later).alias("more"),
                             *[taken[v].alias(f"taken_{v}") for v in (ALLOW, BLOCK)])
        hopeful = [(F.col(v) >= least) & (min_confidence * (F.col(w) - F.col(f"taken_{v}")) <= (1 - min_confidence) * F.col(v) + 1e-6)
                   for v, w in ((ALLOW, BLOCK), (BLOCK, ALLOW))]
        nodes = nodes.where((F.size("more") > 0) & (hopeful[0] | hopeful[1])).select(
            F.monotonically_increasing_id().alias("node"), F.col("node").alias("parent"), "x",
            F.concat("items", F.array("x")).alias("items"),
            F.col(ALLOW).alias(f"n_{ALLOW}"), F.col(BLOCK).alias(f"n_{BLOCK}"), "more")
        nodes = materialize(nodes, "nodes")
        if nodes.isEmpty():
            break
        if node_bits is None:  # single tokens
            node_bits = nodes.select("node", "x").join(bits, "x").select("node", "block", *[F.col(f"b{k}").alias(f"w{k}") for k in words])
        else:
            before = node_bits.withColumnRenamed("node", "parent").join(nodes.select("node", "parent", "x"), "parent")
            node_bits = before.join(bits, ["block", "x"]).select(
                "node", "block", *[F.col(f"w{k}").bitwiseAND(F.col(f"b{k}")).alias(f"w{k}") for k in words])
            node_bits = node_bits.where(reduce(lambda x, y: x | y, [F.col(f"w{k}") != 0 for k in words]))
        node_bits = materialize(node_bits, "node_bits")
        tried = node_bits.join(nodes.select("node", "more"), "node").withColumn("x", F.explode("more")).drop("more").join(bits, ["block", "x"])
        both = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"w{k}").bitwiseAND(F.col(f"b{k}"))) for k in words])
        summed = tried.groupBy("node", "x").agg(
            *[F.sum(F.when(F.col("block") % 2 == odd, both).otherwise(0)).alias(v) for v, odd in ((ALLOW, 0), (BLOCK, 1))])
        counted = materialize(summed.join(nodes.drop("more", "x", "parent"), "node"), "counted")
        hits = F.explode(F.create_map(*[x for v in (ALLOW, BLOCK) for x in (F.lit(v), F.col(v))])).alias("verdict", "hits")
        rules = counted.where(rare_enough).select("items", "x", (F.col(ALLOW) + F.col(BLOCK)).alias("n"), hits)
        rules = rules.where((F.col("hits") >= least) & (F.col("hits") >= min_confidence * F.col("n")))
        found.append(rules.select(
            F.array_sort(F.transform(F.concat("items", F.array("x")), lambda i: F.get(known, i))).alias("tokens"), "verdict",
            (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(float(total))).alias("support")))
    return reduce(DataFrame.unionByName, found, none)


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_count: int = 20,
               common_share: float = 0.95, width: int | None = None) -> DataFrame:
    """``rule_id, tokens, verdict, confidence, support, rarest`` mined from (tokens, verdict).

    A single token is a rule from ``min_count`` labelled URLs on (or
    ``min_support`` of them, if fewer), by one exact aggregate over all
    tokens. Combinations of two or more tokens have ``min_support`` and come
    from :func:`mine_combinations`: all that can be a URL's best rule. With a
    ``width``, FP-growth lists instead every combination, beaten ones too, of
    the ``width`` tokens most associated with a verdict
    (:func:`combined_tokens`): a shorter list, on which no URL should be
    judged. ``rarest`` is the rule's token with the fewest labelled URLs.
    """
    total = labelled.count()
    hashed = labelled.select("verdict", F.explode("tokens").alias("t"), F.pmod(F.xxhash64("tokens"), F.lit(1 << 31)).alias("h"))
    counts = hashed.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), *[F.count_if(F.col("verdict") == v).alias(v) for v in (ALLOW, BLOCK)])
    least = min(min_count, min_support * total)
    blocked = labelled.where(F.col("verdict") == BLOCK).count()
    counts = materialize(counts.where(F.col("n") >= least).withColumn("all_block", F.lit(blocked)), "tokens")
    single = counts.where(F.col("n") <= common_share * total).select(
        "t", "n", F.explode(F.create_map(*[x for v in (ALLOW, BLOCK) for x in (F.lit(v), F.col(v))])).alias("verdict", "hits"))
    single = single.where(F.col("hits") >= min_confidence * F.col("n")).where(F.col("hits") >= least).select(
        F.array("t").alias("tokens"), "verdict", (F.col("hits") / F.col("n")).alias("confidence"),
        (F.col("hits") / F.lit(float(max(total, 1)))).alias("support"))
    if width is None:
        rules = mine_combinations(labelled, counts, total, min_support, min_confidence, common_share).unionByName(single)
    else:
        kept = combined_tokens(counts, total, min_support, common_share, width)
        kept = F.array_intersect("tokens", F.array(*[F.lit(t) for t in kept]).cast("array<string>"))
        items = labelled.select(F.concat(kept, F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"))
        rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
        is_verdict = lambda x: x.startswith(VERDICT)
        rules = rules.where(F.col("consequent")[0].startswith(VERDICT) & ~F.exists("antecedent", is_verdict) & (F.size("antecedent") > 1))
        rules = rules.select(
            F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(VERDICT) + 1, 1 << 20).alias("verdict"),
            "confidence", "support").unionByName(single)
    rules = materialize(rules.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "*"), "rules")
    rarest = rules.select("rule_id", F.explode("tokens").alias("t")).join(counts.select("t", "n"), "t").groupBy("rule_id").agg(
        F.min(F.struct("n", "t")).alias("r"))
    return rules.join(rarest.select("rule_id", F.col("r.t").alias("rarest")), "rule_id")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best mined rule for each distinct set of ``token_sets`` (set_id, tokens): ``set_id, mined, mined_rule``.

    The inverted index holds a rule under its rarest token only, so that a
    token of nearly all URLs is no join key unless it is a rule by itself;
    the rule's other tokens are looked up in the set. Higher confidence
    first, then support, then fewer tokens, then allow.
    """
    index = rules.select("rule_id", F.col("tokens").alias("needed"), "verdict", "confidence", "support", F.col("rarest").alias("token"))
    sets = token_sets.select("set_id", "tokens", F.explode("tokens").alias("token"))
    fired = sets.join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    rank = F.struct(F.col("confidence"), F.col("support"), -F.size("needed"), (F.col("verdict") == ALLOW).alias("a"), F.col("rule_id"))
    return fired.groupBy("set_id").agg(
        F.max_by("verdict", rank).alias("mined"), F.max_by(F.array_join("needed", " "), rank).alias("mined_rule"))


def judge_urls(pages: DataFrame, rules: tuple = RULES, min_support: float = 0.02, min_confidence: float = 0.95,
               min_count: int = 20, default: str = ALLOW, width: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule`` for every row of ``pages``.

    A null URL, or one without ``://``, has empty host and path and is judged
    by its few tokens, else by ``default``. Long URLs are taken whole: every
    folder, key and key=value pair is a token.
    Repeated rows are judged alike. Ties between mined rules go to
    support, then fewer tokens, then allow, then rule id. Without labelled URLs
    (an empty table too) nothing is mined. Extra columns are ignored.
    """
    df = split_url(pages.select("page_id", "url"))
    text, verdict = fixed_rule(rules)
    df = materialize(df.withColumn("rule", text).withColumn("verdict", verdict).withColumn("tokens", url_tokens()).drop("url").withColumn(
        "set_id", F.struct(F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens"))), "urls")
    labelled, open_ = df.where("verdict IS NOT NULL"), df.where("verdict IS NULL")
    if labelled.isEmpty():
        matched = open_.withColumn("mined", F.lit(None).cast("string")).withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        mined = materialize(mine_rules(labelled, min_support, min_confidence, min_count, width=width), "mined")
        sets = open_.groupBy("set_id").agg(F.any_value("tokens").alias("tokens"))
        best = materialize(match_rules(sets, mined), "best")
        matched = open_.drop("tokens").join(best, "set_id", "left")
    cols = ("page_id", "host", "path", "rule")
    return labelled.select(*cols, "verdict", F.lit(None).cast("string").alias("mined_rule")).unionByName(
        matched.select(*cols, F.coalesce("mined", F.lit(default)).alias("verdict"), "mined_rule"))
