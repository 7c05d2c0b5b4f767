"""Product labels onto order lines (D1, D2) and line-level rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.config import DEFAULT_CONFIG, LoyaltyConfig

LABEL_COLUMNS = ("Category", "Sub_category", "Product_SKU_Name", "Product_Variant", "Brand", "Pack_Size")
ROW_TAG = "_row_tag"


def tag_file_order(labels: DataFrame) -> DataFrame:
    """Tag label rows with (file name, an id that grows with the position in the file).

    Call right after reading: the splits of one file are scanned in byte
    order and ids grow with the partition index, so the id orders a file's
    rows as they appear; files themselves are scanned by size, so their name
    comes first. Scans are deterministic, so a recomputed partition gets the
    same tags.
    """
    return labels.withColumn(ROW_TAG, F.struct(F.input_file_name().alias("file"),
                                               F.monotonically_increasing_id().alias("row")))


def dedupe_labels(labels: DataFrame, id_col: str = "ID") -> DataFrame:
    """One label row per trimmed, non-empty id; the last row in the file wins.

    ``labels`` must carry the tag of :func:`tag_file_order` (or is tagged
    here). ``max_by`` is a partial aggregate, so a hot id is combined
    map-side and never gathered into one task.
    """
    if ROW_TAG not in labels.columns:
        labels = tag_file_order(labels)
    present = [c for c in LABEL_COLUMNS if c in labels.columns]
    keyed = labels.select(F.trim(F.col(id_col)).alias("ID"), ROW_TAG, *present).where(
        F.col("ID").isNotNull() & (F.col("ID") != "")
    )
    # one max_by per column (tags are unique, so all pick the same row); a
    # dataset that needs only some label columns lets Catalyst drop the rest,
    # down to the scan and the broadcast
    return keyed.groupBy("ID").agg(*[F.max_by(c, ROW_TAG).alias(c) for c in present])


def label_order_lines(lines: DataFrame, labels: DataFrame, id_col: str = "SKU_ID",
                      missing_value: str | None = None, dedupe: bool = True, flag: str | None = None,
                      hot_ids: tuple = ()) -> DataFrame:
    """Append the six label columns by trimmed product id (left join).

    Labels are de-duplicated first, so the join cannot multiply lines. No
    broadcast hint: the planner broadcasts the label side only while its
    estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE
    re-checks with the real size) and uses a sort-merge join beyond it;
    AQE's skew-join split covers a hot product id in that case, and so do
    ``hot_ids`` (:func:`hot_product_ids`) without relying on it: their few
    labels are broadcast, and their lines are dealt over all tasks of the
    join by a salted key that meets no label. ``flag`` names a boolean column
    to add: whether the line has a label.
    """
    lab = dedupe_labels(labels) if dedupe else labels
    lab = lab.withColumnRenamed("ID", "_label_id")
    # lines already carrying label columns lose them (re-labelling)
    base = lines.drop(*[c for c in LABEL_COLUMNS if c in lines.columns])
    key = F.trim(F.col(id_col))
    if hot_ids:
        hot = F.coalesce(key.isin(*hot_ids), F.lit(False))
        salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*base.columns), F.lit(1 << 16)).cast("string"))
        few = lab.where(F.col("_label_id").isin(*hot_ids))
        few = few.select(F.struct(*[c for c in lab.columns]).alias("_hot"))  # one row per hot id at most
        out = base.join(lab, F.when(hot, salt).otherwise(key) == F.col("_label_id"), "left")
        out = out.join(F.broadcast(few), key == F.col("_hot._label_id"), "left")
        out = out.select(*base.columns, *[F.coalesce(c, F.col("_hot")[c]).alias(c) for c in lab.columns])
    else:
        out = base.join(lab, key == F.col("_label_id"), "left")
    hit = F.col("_label_id").isNotNull()
    if flag:
        out = out.withColumn(flag, hit)
    if missing_value is not None:
        out = out.select(
            *base.columns, *([flag] if flag else []),
            *[F.when(hit, F.col(c)).otherwise(F.lit(missing_value).cast(lab.schema[c].dataType)).alias(c)
              for c in LABEL_COLUMNS if c in lab.columns],
        )
    return out.drop("_label_id")


def hot_product_ids(lines: DataFrame, share: float = 0.01, id_col: str = "SKU_ID") -> tuple:
    """The product ids with more than ``share`` of all lines: at most 1 / ``share`` of them, by one count."""
    counts = lines.groupBy(F.trim(F.col(id_col)).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.join(F.broadcast(total), F.col("n") > F.col("total") * share).where("id IS NOT NULL")  # one row
    return tuple(sorted(r["id"] for r in hot.collect()))


def missing_label_ids(lines: DataFrame, labels: DataFrame, id_col: str = "SKU_ID") -> DataFrame:
    """Trimmed ids of lines with no label, one row per line; NULL ids skipped."""
    lab = dedupe_labels(labels).select(F.col("ID").alias("_label_id"))
    ids = lines.select(F.trim(F.col(id_col)).alias("Missing_ID")).where(F.col("Missing_ID").isNotNull())
    return ids.join(lab, ids.Missing_ID == lab._label_id, "left_anti")


def flag_gifts(lines: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """A zero-value line of a normal (non-sample) order is a gift."""
    gift = (F.col("SKU_Subtotal_Before_Discount") == 0) & F.col("Normal_Or_Pre_order").isNotNull()
    return lines.withColumn(
        "Category", F.when(gift, F.lit(cfg.gift_category)).otherwise(F.col("Category"))
    )


def non_gift_lines(lines: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG) -> DataFrame:
    """``Category != gift`` — unlabelled (NULL) lines drop out too."""
    return lines.where(F.col("Category") != F.lit(cfg.gift_category))


def non_affiliate_lines(lines: DataFrame) -> DataFrame:
    """Lines of normal / pre-order orders (affiliate samples have NULL)."""
    return lines.where(F.col("Normal_Or_Pre_order").isNotNull())


def named_buyer_lines(lines: DataFrame) -> DataFrame:
    """Lines with a non-empty buyer name (NULL drops out too)."""
    return lines.where(F.col("Buyer_Username") != F.lit(""))


def prepared_lines(lines: DataFrame, labels: DataFrame, cfg: LoyaltyConfig = DEFAULT_CONFIG,
                   dedupe: bool = True, flag: str | None = None, hot_ids: tuple = ()) -> DataFrame:
    """Labelled, gift-flagged order lines — the input of every dataset."""
    return flag_gifts(label_order_lines(lines, labels, dedupe=dedupe, flag=flag, hot_ids=hot_ids), cfg)
