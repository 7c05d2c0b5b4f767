"""S1-S4 — reading the shop export and the label table.

The export is one row per SKU line with a header row and one description
row under it; every cell is text. Spark has no spreadsheet reader, so
the sheets come in saved as CSV (or already as Parquet), one file per
export. Each file is read by its own header: files are grouped by header,
one reader per distinct header, and united by column name. Text is cast once
to a typed schema; unparsable cells become NULL instead of failing the job
and :func:`rejects` counts them, or their lines go to a quarantine
(:func:`split_order_lines`). No line is dropped unseen.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyalframe.config import EXPORT_TIME_FORMAT
from loyalframe.operators.labelling import LABEL_COLUMNS, tag_file_order
from loyalframe.sources.sinks import CSV_QUOTES

ID_COLUMN = "ID"
# label columns as the label file names them (fixed values)
LABEL_HEADERS = ("Category", "Sub-category", "Product SKU Name", "Product Variant", "Brand", "Pack Size")
MONEY_COLUMNS = (
    "Order_Amount", "SKU_Unit_Original_Price", "SKU_Subtotal_Before_Discount", "SKU_Seller_Discount",
    "SKU_Subtotal_After_Discount",
)
ID_COLUMNS = ("Order_ID", "SKU_ID")
# what the datasets need of every export
REQUIRED_COLUMNS = ("Order_ID", "SKU_ID", "Order_Status", "Normal_Or_Pre_order", "Created_Time", "Buyer_Username", "Quantity",
                    *MONEY_COLUMNS)
EXPORT_FILE, EXPORT_BLOCK, EXPORT_ROW, IS_DESCRIPTION = "Export_File", "Export_Block", "Export_Row", "Is_Description"
EXPORT_ORDER = (EXPORT_FILE, EXPORT_BLOCK, EXPORT_ROW)
SKU_ID_INDEX = 5  # the export's 6th column is the product id


def clean_headers(cols: list[str]) -> list[str]:
    """S3: trim, spaces and '-' to '_', a blank header becomes ``column_<i>``."""
    out = []
    for i, c in enumerate(cols):
        c = (c or "").strip()
        out.append(c.replace(" ", "_").replace("-", "_") if c else f"column_{i}")
    return out


def _strip_bom(cols: list[str]) -> list[str]:
    return [cols[0].lstrip("\ufeff"), *cols[1:]] if cols else cols


def export_files(spark: SparkSession, path: str | list) -> list[str]:
    """The data files below ``path`` (a file, folder, glob or list of them), as Spark lists them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return sorted(r["path"] for r in listed.collect())  # names only; contents are not read


def _head(spark: SparkSession, file: str, multi_line: bool) -> tuple[list, list]:
    """Header and first data row of a CSV file (cells as text, None if blank); only the file's start is read."""
    rows = spark.read.options(**CSV_QUOTES).option("header", False).option("multiLine", multi_line).csv(file).limit(2).collect()
    cells = [list(r) for r in rows]
    return (cells[0] if cells else []), (cells[1] if len(cells) > 1 else [])


def _header_names(file: str, header: list) -> list[str]:
    names = name_sku_column(clean_headers(_strip_bom([c or "" for c in header])))
    low = [n.lower() for n in names]
    twice = sorted({n for n, k in zip(names, low) if low.count(k) > 1})
    missing = [c for c in REQUIRED_COLUMNS if c.lower() not in low]
    if twice or missing:
        raise ValueError(f"export file {file}: " + "; ".join(
            [*(["no column " + ", ".join(missing)] if missing else []), *(["column twice: " + ", ".join(twice)] if twice else [])]))
    canonical = {c.lower(): c for c in REQUIRED_COLUMNS}
    return [canonical.get(k, n) for n, k in zip(names, low)]


def read_raw_export(spark: SparkSession, path: str | list, fmt: str = "csv", multi_line: bool = True,
                    ordinal: bool = False) -> DataFrame:
    """S1 + S3: the cells of all export files under ``path`` as text, by column name.

    Adds ``Export_File`` and ``Is_Description``. Files may order their columns
    differently and hold more of them: a column that a file does not have is
    NULL in its lines. A file without a required column (``REQUIRED_COLUMNS``),
    or with two columns of one name, raises ``ValueError`` naming it. The 6th
    column is the product id unless one is named ``SKU_ID``.

    The description row is a file's first data row when none of its id,
    time, quantity and money cells holds a digit, and any further row of
    the same texts; it is marked, not dropped. Per file two small jobs read
    its start. ``multi_line`` reads quoted cells with line breaks; a file is
    then one task, so exports known to have no line breaks in cells, and to be
    large, are better read with it off. Files without any row are skipped.
    ``ordinal`` adds ``EXPORT_ORDER``: file, block of the file and a number
    that grows with the row's place in it, in the order of the exports' rows.
    """
    tags = [F.col("_metadata.file_path").alias(EXPORT_FILE)]
    if ordinal:
        tags += [F.col("_metadata.file_block_start").alias(EXPORT_BLOCK), F.monotonically_increasing_id().alias(EXPORT_ROW)]
    if fmt != "csv":
        raw = spark.read.format(fmt).load(path)
        names = _header_names(str(path), raw.columns)
        raw = raw.toDF(*names).select("*", *tags)
        return raw.withColumn(IS_DESCRIPTION, _no_digits(raw))
    files = export_files(spark, path)
    with ThreadPoolExecutor(8) as pool:
        heads = dict(zip(files, pool.map(lambda f: _head(spark, f, multi_line), files)))
    groups: dict[tuple, list] = {}
    for file, (header, _) in heads.items():
        if header:
            groups.setdefault(tuple(_header_names(file, header)), []).append(file)
    if not groups:
        raise ValueError(f"no export file with a header under {path}")
    parts = []
    for names, members in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.schema(schema).options(**CSV_QUOTES).option("header", True).option("multiLine", multi_line).csv(members)
        described = {tuple(row) for row in (heads[f][1] for f in members) if row and _describes(names, row)}
        marked = F.lit(False)
        for row in sorted(described, key=str):  # a text or two: the export's own wording
            marked = marked | reduce(lambda x, y: x & y, [F.col(f"`{n}`").eqNullSafe(F.lit(v)) for n, v in zip(names, row)])
        parts.append(raw.select("*", *tags, marked.alias(IS_DESCRIPTION)))
    raw = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    last = [c for c in (*EXPORT_ORDER, IS_DESCRIPTION) if c in raw.columns]
    return raw.select(*[c for c in raw.columns if c not in last], *last)


def _describes(names: tuple, row: list) -> bool:
    typed = {c.lower() for c in (*ID_COLUMNS, "Created_Time", "Quantity", *MONEY_COLUMNS)}
    return not any(ch.isdigit() for n, v in zip(names, row) if n.lower() in typed for ch in v or "")


def read_order_lines(spark: SparkSession, path: str | list, fmt: str = "csv", multi_line: bool = True,
                     money: str = "bigint") -> DataFrame:
    """S1 + S3 + S4: the order exports under ``path`` as typed order lines; see :func:`read_raw_export`."""
    return cast_order_lines(read_raw_export(spark, path, fmt, multi_line), money).drop(EXPORT_FILE)


def name_sku_column(names: list[str]) -> list[str]:
    """The 6th column is the product id, whatever an export calls it."""
    if "SKU_ID" not in names and len(names) > SKU_ID_INDEX:
        names = [*names[:SKU_ID_INDEX], "SKU_ID", *names[SKU_ID_INDEX + 1:]]
    return names


def _number(c: str, kind: str):
    """Text as a number of type ``kind``: "200" and "200.0" alike; "1,000" or "2kg" is no number.

    A value that ``kind`` cannot hold exactly ("100.5" as a whole number)
    becomes NULL rather than another value. Nearly all cells are whole
    numbers in their plain spelling ("200", "200.0"): those are cast straight
    to bigint and known by writing them again; only other texts need decimals.
    """
    text = F.trim(F.col(c).cast("string"))
    exact = text.try_cast("decimal(38,6)")
    any_spelling = F.when(exact.try_cast(kind).cast("decimal(38,6)") == exact, exact.try_cast(kind))
    if kind != "bigint":
        return any_spelling
    whole = F.substring_index(text, ".", 1).try_cast("bigint")
    plain = (text == whole.cast("string")) | (text == F.concat(whole.cast("string"), F.lit(".0")))
    # a text without any digit is no number either: no decimal is tried on "n/a"
    return F.when(plain, whole).when(text.rlike("[0-9]"), any_spelling)


def _number_columns(df: DataFrame) -> list[str]:
    return [c for c in ("Quantity", *MONEY_COLUMNS) if c in df.columns]


def _no_digits(df: DataFrame):
    """True for a row without a digit in any cell where an id, a time or a number belongs."""
    cells = [F.col(c).cast("string") for c in (*[c for c in ID_COLUMNS if c in df.columns], "Created_Time", *_number_columns(df))]
    # cell by cell, ids first: the cells after the first one with a digit are not even made
    return ~reduce(lambda x, y: x | y, [F.coalesce(c.rlike("[0-9]"), F.lit(False)) for c in cells])


def cast_order_lines(df: DataFrame, money: str = "bigint") -> DataFrame:
    """Parse times and numbers once; drop the export's description row.

    Only the description row is dropped: the rows that
    :func:`read_raw_export` marked, or, in a frame read otherwise (a stream),
    rows without a digit in their id, time, quantity and money cells. A line
    with a cell that does not parse stays, with NULL there. ``money`` is the
    type of amounts: whole units by default, ``decimal(18,2)`` for exports
    with fractions.
    """
    t = F.try_to_timestamp(F.trim(F.col("Created_Time").cast("string")), F.lit(EXPORT_TIME_FORMAT))
    described = F.col(IS_DESCRIPTION) if IS_DESCRIPTION in df.columns else _no_digits(df)
    kept = df.where(~described).drop(IS_DESCRIPTION)
    return kept.withColumns({
        "Created_At": t,
        **{c: _number(c, "bigint" if c == "Quantity" else money) for c in _number_columns(df)},
    })


class IngestSplit(NamedTuple):
    """The three outputs of :func:`split_order_lines`; together they are the rows of the input."""

    lines: DataFrame
    quarantine: DataFrame
    descriptions: DataFrame


def split_order_lines(raw: DataFrame, money: str = "bigint") -> IngestSplit:
    """S4 with a quarantine: lines whose cells all parse, lines with a cell that does not, description rows.

    ``raw`` is the output of :func:`read_raw_export`. A blank cell is no
    fault. ``quarantine`` has the raw cells and ``Rejected``, the faulty
    cells as an array of (Column, Text); :func:`quarantined_cells` lists them.
    """
    parsed = {"Created_Time": F.try_to_timestamp(F.trim(F.col("Created_Time").cast("string")), F.lit(EXPORT_TIME_FORMAT)),
              **{c: _number(c, "bigint" if c == "Quantity" else money) for c in _number_columns(raw)}}
    bad = {c: F.coalesce((F.trim(F.col(c).cast("string")) != "") & v.isNull(), F.lit(False)) for c, v in parsed.items()}
    faulty = reduce(lambda x, y: x | y, bad.values())
    # arrays are made of faulty lines only: they are slow next to the test itself
    rejected = F.array_compact(F.array(*[
        F.when(b, F.struct(F.lit(c).alias("Column"), F.col(c).cast("string").alias("Text"))) for c, b in bad.items()]))
    data = raw.where(~F.col(IS_DESCRIPTION))
    return IngestSplit(cast_order_lines(data.where(~faulty), money),
                       data.where(faulty).withColumn("Rejected", rejected).drop(IS_DESCRIPTION),
                       raw.where(IS_DESCRIPTION).drop(IS_DESCRIPTION))


def quarantined_cells(quarantine: DataFrame) -> DataFrame:
    """``Export_File, Order_ID, Column, Text``: one row per rejected cell."""
    return quarantine.select(EXPORT_FILE, "Order_ID", F.inline("Rejected"))


def rejects(df: DataFrame, money: str = "bigint") -> DataFrame:
    """Cells of the raw export that :func:`cast_order_lines` turns into NULL: ``Column, Num_Rejected``.

    One row per typed column (0 if all parse), counted in one pass; blank
    cells and the description row are no rejects.
    """
    cast = cast_order_lines(df.withColumns({f"_raw_{c}": F.col(c) for c in _number_columns(df)}), money)
    raw = {"Created_Time": ("Created_Time", "Created_At"), **{c: (f"_raw_{c}", c) for c in _number_columns(df)}}
    bad = [F.count(F.when((F.trim(F.col(text).cast("string")) != "") & F.col(typed).isNull(), 1)).alias(name)
           for name, (text, typed) in raw.items()]
    pairs = F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).alias("Num_Rejected")) for c in raw])
    return cast.agg(*bad).select(F.inline(pairs))


def pack_size(c: str = "Pack_Size"):
    """Leading number of a pack-size text ('500', '1.5', '2kg' -> 2); else NULL."""
    num = F.regexp_extract(F.trim(F.col(c)), r"^[+-]?(\d+(\.\d*)?|\.\d+)", 0)
    return F.when(num != "", num).try_cast("decimal(18,3)")


def read_labels(spark: SparkSession, path: str, id_column: str = ID_COLUMN,
                label_headers: tuple = LABEL_HEADERS) -> DataFrame:
    """The product label file (CSV, BOM tolerated).

    Missing required columns raise ``ValueError`` naming them. Values are
    trimmed and a blank label is the empty text, not NULL (only lines without
    any label have NULL); rows with an empty id are skipped; a duplicated id
    keeps its last row: the last in its file, and of several files the last
    by name (rows are tagged right after the read, and
    :func:`~loyalframe.operators.labelling.dedupe_labels` keeps the largest
    tag).
    """
    raw = spark.read.options(**CSV_QUOTES).option("header", True).option("inferSchema", False).csv(path)
    cols = _strip_bom(raw.columns)
    missing = [c for c in (id_column, *label_headers) if c not in cols]
    if missing:
        raise ValueError(f"label file {path} has no column " + ", ".join(missing))
    raw = tag_file_order(raw.toDF(*cols))
    wanted = dict(zip(label_headers, LABEL_COLUMNS))
    out = raw.select(
        F.trim(F.col(f"`{id_column}`")).alias("ID"),
        *[F.coalesce(F.trim(F.col(f"`{h}`")), F.lit("")).alias(n) for h, n in wanted.items()],
        "_row_tag",
    )
    return out.withColumn("Pack_Size", pack_size()).where(F.col("ID").isNotNull() & (F.col("ID") != ""))
