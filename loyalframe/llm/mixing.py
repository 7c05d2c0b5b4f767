"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is
expected ``target / source_size`` times. Documents of a source stand in a
fixed order, the expected copies are prefix-summed along it, one random
offset per source is added and a document is emitted once per integer
boundary that its interval crosses.

The order is by size, in logarithmic bins: the words taken then differ
from the target by about one document's size, however uneven the sizes.
The position of a document is the sum of three counts, so that no source is
ever sorted in one task: documents in lower (bin, salt) groups of its
source, plus its row number within its own group. A group is salted by a
hash of the document into parts of about ``part_rows`` rows. As all
documents of a source have the same expectation, the prefix sum of expected
copies is position times expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyalframe.llm.common import materialize, text_of

WORD = r"[^\x20\x09-\x0D]+"


def size_bin() -> Column:
    """Logarithmic bin of ``size``: its bit length and its four leading bits after the first."""
    return F.expr("CASE WHEN size = 0 THEN 0 ELSE "
                  "length(bin(size)) * 16 + shiftright(size * 16, length(bin(size)) - 1) END").cast("int")


def hex_number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 as a number: repeatable, and the same in other engines."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple = (3.0, 1.0, 2.0), total_share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """Targets of ``sources`` (source, source_size): ``source, source_size, target``.

    Sources by code point, null last, take ``weights`` in turn and share
    ``total_share`` of all words; a target stops at ``max_repeat`` times the
    source's size and what is over is shared again by weight. The fixed
    point is a common level: target = min(cap, level * weight). Sorted by
    cap / weight the capped sources come first, so the level follows from
    running sums. The unpartitioned windows see one row per source.
    """
    if not total_share <= max_repeat:
        raise ValueError("total_share must not be above max_repeat: the targets could not be met")
    n = len(weights)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    s = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = s.withColumns({
        "_total": F.sum("source_size").over(everything) * F.lit(float(total_share)),
        "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_w_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("_level", (F.col("_total") - F.col("_cap_before")) / F.col("_w_left"))
    s = s.withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    level = F.first("_fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding,
                                                                      Window.unboundedFollowing))
    s = s.withColumn("_level", level)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.alias("target"))


def mixture(docs: DataFrame, **params) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` counts words (runs of anything but space and ``\\x09-\\x0D``);
    a null or empty text has 0. A null source is a source of its own, last
    in order. Repeated rows are rows like any other, each with its own
    position; rows equal in every column stand next to each other and share
    their copies in any order. An empty table gives an empty result. Extra
    columns are ignored. The same rows and seed
    give the same result. A source without words has target 0 and is not
    taken.
    """
    return _placed(docs, (), **params)


def _placed(docs: DataFrame, keep: tuple, weights: tuple = (3.0, 1.0, 2.0), total_share: float = 1.5,
            max_repeat: float = 2.0, seed: int = 7, part_rows: int = 4096) -> DataFrame:
    """:func:`mixture` with the columns of ``keep`` under ``_keep_`` names."""
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # never null: one join key
    sized = materialize(docs.select(
        "doc_id", "source", source_key.alias("_s"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("_h"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).withColumn("_bin", size_bin()), "sized")
    groups = materialize(sized.groupBy("_s", "source", "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words")), "groups")
    targets = source_targets(groups.groupBy("source").agg(F.sum("_words").alias("source_size")),
                             weights, total_share, max_repeat)
    targets = targets.select(source_key.alias("_s"), "source_size", "target")
    plan = materialize(groups.join(targets, "_s").select(
        "_s", "_bin", "source_size", "target", F.ceil(F.col("_n") / F.lit(part_rows)).alias("_parts")), "plan")
    rows = sized.join(plan, ["_s", "_bin"]).withColumn(
        "_part", hex_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8) % F.col("_parts"))
    # offset of each part: rows of the source in lower (bin, part) groups
    parts = materialize(rows.groupBy("_s", "_bin", "_part").agg(F.count(F.lit(1)).alias("_n")), "parts")
    lower = Window.partitionBy("_s").orderBy("_bin", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_s", "_bin", "_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_s", "_bin", "_part").orderBy("size", "doc_id", "_h")
    placed = rows.withColumn("_row", F.row_number().over(within)).join(offsets, ["_s", "_bin", "_part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = hex_number(F.concat(F.lit(f"{seed}:"), F.col("_s")), 13) / F.lit(float(1 << 52))
    at = F.col("_before") + F.col("_row")
    copies = F.floor(at * F.col("_rate") + F.col("_u")) - F.floor((at - 1) * F.col("_rate") + F.col("_u"))
    return placed.withColumn("_rate", rate).withColumn("_u", start).withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *[f"_keep_{c}" for c in keep])


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents: every input column, one row per emitted copy."""
    names = docs.columns
    counted = _placed(docs, tuple(names), **params)
    return counted.where("copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        *[F.col(f"_keep_{c}").alias(c) for c in names])
