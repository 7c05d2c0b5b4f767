"""Sources, sinks and the streaming ingest on scratch folders."""

import csv

import pytest
from pyspark.sql import functions as F

from loyalframe.operators.labelling import label_order_lines
from loyalframe.plans.pipeline import LoyaltyData
from loyalframe.operators.orders import orders_frame
from loyalframe.sources.ingest import cast_order_lines, clean_headers, read_labels, read_order_lines, rejects
from loyalframe.sources.sinks import export_all, read_dataset, row_counts, write_dataset, write_labelled_csv
from loyalframe.streaming import current_order_lines, start_order_line_ingest

HEADER = ["Order ID", "Order Status", "Normal or Pre-order", "Created Time", "Buyer Username", "SKU ID", "Quantity",
          "Order Amount", "SKU Unit Original Price", "SKU Subtotal Before Discount", "SKU Seller Discount",
          "SKU Subtotal After Discount"]
ROWS = [
    ["o1", "Đã hoàn tất", "Normal", "05/01/2026 10:00:31", "ann", "K1", "2", "200", "100", "200", "0", "200"],
    ["o1", "Đã hoàn tất", "Normal", "05/01/2026 10:00:31", "ann", "R1", "1", "200", "50", "0", "0", "0"],
    ["o2", "Đã hủy", "", "06/02/2026 23:59:00", "bob", "S1", "1", "90", "90", "90", "0", "90"],
    ["o3", "Đã hoàn tất", "Normal", "07/02/2026 08:00:00", "", "ZZ", "1", "50", "50", "50", "0", "50"],
]
LABELS = [["﻿ID", "Category", "Sub-category", "Product SKU Name", "Product Variant", "Brand", "Pack Size"],
          ["K1", "Tea", "Tea/1", "tea", "1 box", "Kinka", "500"],
          [" R1 ", "Home", "Home/1", "soap", "1 bottle", "Revy", "1.5"],
          ["S1", "Care", "Care/1", "cream", "1 jar", "SiMee", "2kg"],
          ["K1", "Tea", "Tea/1", "tea", "1 box", "Kinka", "250"],
          ["", "x", "x", "x", "x", "x", "1"]]


def _csv(path, rows, description=True):
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(rows[0])
        if description:
            w.writerow(["(description row)"] + [""] * (len(rows[0]) - 1))
        w.writerows(rows[1:])


def test_clean_headers():
    assert clean_headers([" Order ID ", "Sub-category", "", None]) == ["Order_ID", "Sub_category", "column_2", "column_3"]


def test_read_export_and_labels(spark, tmp_path):
    _csv(tmp_path / "export.csv", [HEADER] + ROWS)
    with open(tmp_path / "labels.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(LABELS)
    lines = read_order_lines(spark, str(tmp_path / "export.csv"))
    assert lines.count() == 4  # description row dropped
    assert "SKU_ID" in lines.columns and dict(lines.dtypes)["Quantity"] == "bigint"
    labels = read_labels(spark, str(tmp_path / "labels.csv"))
    got = {r.SKU_ID: (r.Brand, r.Pack_Size) for r in label_order_lines(lines, labels).collect()}
    assert got["K1"][0] == "Kinka" and float(got["K1"][1]) == 250.0  # last duplicate wins
    assert float(got["R1"][1]) == 1.5 and float(got["S1"][1]) == 2.0 and got["ZZ"] == (None, None)
    d = LoyaltyData(lines, labels)
    # an empty buyer cell reads as NULL in CSV, so o3 joins the pseudo buyer
    assert {r.Buyer_Username for r in d.customers.collect()} == {"ann", "bob", "No Username"}
    assert d.orders.count() == 3


def test_missing_label_columns(spark, tmp_path):
    with open(tmp_path / "bad.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows([["ID", "Category", "Brand"], ["a", "b", "c"]])
    with pytest.raises(ValueError, match="Sub-category, Product SKU Name, Product Variant, Pack Size"):
        read_labels(spark, str(tmp_path / "bad.csv"))


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], "Order_Month string, n long")
    write_dataset(df, str(tmp_path / "a"), partition_by=["Order_Month"])
    assert sorted(r.n for r in read_dataset(spark, str(tmp_path / "a")).collect()) == [1, 2]
    write_labelled_csv(df, str(tmp_path / "c"))
    assert read_dataset(spark, str(tmp_path / "c"), "csv").count() == 2
    paths = export_all({"x": lambda: df, "y": lambda: df.limit(1)}, str(tmp_path / "all"))
    assert len(paths) == 2
    counts = {r.Dataset: r.Num_Rows for r in row_counts({"x": df, "y": df.where(F.col("n") > 1)}).collect()}
    assert counts == {"x": 2, "y": 1}


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "exports"
    src.mkdir()
    _csv(src / "e1.csv", [HEADER] + ROWS[:2], description=True)
    _csv(src / "e2.csv", [HEADER] + ROWS[2:], description=False)
    with open(tmp_path / "labels.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(LABELS)
    labels = read_labels(spark, str(tmp_path / "labels.csv"))
    q = start_order_line_ingest(spark, str(src), labels, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4
    assert {r.SKU_ID: r.Brand for r in out.collect()}["S1"] == "SiMee"
    # a restart finds nothing new
    q2 = start_order_line_ingest(spark, str(src), labels, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q2.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_streaming_ingest_bounded_batches(spark, tmp_path):
    # a backlog of two exports with one file per trigger: two micro-batches,
    # every line ingested once
    src = tmp_path / "exports"
    src.mkdir()
    _csv(src / "e1.csv", [HEADER] + ROWS[:2], description=False)
    _csv(src / "e2.csv", [HEADER] + ROWS[2:], description=False)
    with open(tmp_path / "labels.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(LABELS)
    labels = read_labels(spark, str(tmp_path / "labels.csv"))
    q = start_order_line_ingest(spark, str(src), labels, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                                max_files_per_trigger=1)
    q.awaitTermination(120)
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_whole_pipeline_run(spark, tmp_path):
    from loyalframe.plans.run import PIPELINE_DATASETS, run_pipeline

    _csv(tmp_path / "export.csv", [HEADER] + ROWS)
    with open(tmp_path / "labels.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(LABELS)
    data = LoyaltyData(read_order_lines(spark, str(tmp_path / "export.csv")),
                       read_labels(spark, str(tmp_path / "labels.csv")))
    counts = {r.Dataset: r.Num_Rows for r in run_pipeline(data, str(tmp_path / "out")).collect()}
    assert counts["total_orders_data"] == 3 and counts["label_order_lines"] == 4
    assert counts["missing_label_ids"] == 1
    for n in PIPELINE_DATASETS:
        assert (tmp_path / "out" / n).exists()
    assert read_dataset(spark, str(tmp_path / "out" / "total_customers_data")).count() == 3


def _raw(spark, *rows):
    cols = ["Order_ID", "Created_Time", "Quantity", "Order_Amount"]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_only_the_description_row_is_dropped(spark):
    raw = _raw(spark, ("Platform order id", "dd/mm/yyyy", "", ""), ("o1", "2026-02-05 10:00:31", "1.0", "200.0"),
               ("o2", "05/02/2026 10:00:31", "x", "100.5"), ("o3", None, "3", " 7 "))
    got = {r.Order_ID: (r.Created_At is None, r.Quantity, r.Order_Amount) for r in cast_order_lines(raw).collect()}
    assert got == {"o1": (True, 1, 200), "o2": (False, None, None), "o3": (True, 3, 7)}
    assert {r.Order_ID: r.Order_Amount and float(r.Order_Amount)
            for r in cast_order_lines(raw, money="decimal(18,2)").collect()}["o2"] == 100.5
    assert {r.Column: r.Num_Rejected for r in rejects(raw).collect()} == {
        "Created_Time": 1, "Quantity": 1, "Order_Amount": 1}


def test_blank_labels_and_several_label_files(spark, tmp_path):
    d = tmp_path / "labels"
    d.mkdir()
    with open(d / "a_first.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows([LABELS[0], ["K1", "", "Tea/1", "old", "1 box", "Kinka", "500"]])
    with open(d / "b_last.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows([LABELS[0]] + [[f"X{i}", "c", "c", "n" * 40, "v", "Revy", "1"] for i in range(300)]
                                 + [["K1", "", "Tea/1", "new", "1 box", "Kinka", "250"]])
    lines = spark.createDataFrame([("K1",), ("ZZ",)], "SKU_ID string")
    got = {r.SKU_ID: (r.Category, r.Product_SKU_Name) for r in label_order_lines(lines, read_labels(spark, str(d))).collect()}
    assert got == {"K1": ("", "new"), "ZZ": (None, None)}


def test_csv_read_back_keeps_text_and_given_types(spark, tmp_path):
    df = spark.createDataFrame([("2026-01", "0012", 3)], "Order_Month string, Order_ID string, n long")
    write_dataset(df, str(tmp_path / "d"), "csv")
    assert read_dataset(spark, str(tmp_path / "d"), "csv").collect()[0] == ("2026-01", "0012", "3")
    assert read_dataset(spark, str(tmp_path / "d"), "csv", df.schema).collect() == df.collect()
    write_labelled_csv(df, str(tmp_path / "h"), header_row=["Month", "Order", "N"], bom=True)
    text = next((tmp_path / "h").glob("part-*")).read_text(encoding="utf-8")
    assert text.splitlines()[0] == "\ufeffMonth,Order,N"


def test_order_with_disagreeing_lines_is_one_order(spark):
    from tests.fixtures import LINE_SCHEMA, labels, line, t

    when = t("2026-01-05 10:00")
    rows = [line("o1", "K", when, "ann", amount=200, status="Đã hủy"),
            line("o1", "R", when, None, amount=150, status="Đã hoàn tất"),
            line("o2", "K", when, None, amount=90)]
    d = LoyaltyData(spark.createDataFrame(rows, LINE_SCHEMA), labels(spark))
    got = {r.Order_ID: r for r in orders_frame(d.lines).collect()}
    assert d.orders.count() == len(got) == 2 and got["o1"].Order_Amount == 200 and got["o1"].Buyer_Username == "ann"
    assert got["o1"].Order_Status == "Đã hủy" and got["o1"].Sum_SKU_Subtotal_After_Discount == 200
    assert got["o1"].Basket_Num_Kinka_Products == 1 and got["o1"].Basket_Num_Revy_Products == 1
    assert got["o2"].Buyer_Username == "No Username"
    ann = {r.Buyer_Username: r for r in d.customers.collect()}["ann"]
    assert ann.Num_of_Orders == 1 and ann.Total_Customer_Spending == 200


def test_fields_of_different_lines_are_never_mixed(spark):
    from tests.fixtures import LINE_SCHEMA, labels, line, t

    rows = [line("o1", "K", t("2026-01-05 10:00"), "zoe", amount=900), line("o1", "R", t("2026-01-06 10:00"), "ann", amount=100),
            line(None, "K", t("2026-01-05 10:00"), "bob"), line(None, "K", t("2026-01-05 10:00"), None),
            line("o2", "K", None, None, amount=None), line("o2", "K", t("2026-01-05 10:00"), None, amount=5)]
    d = LoyaltyData(spark.createDataFrame(rows, LINE_SCHEMA), labels(spark))
    got = {r.Order_ID: (r.Buyer_Username, r.Order_Amount, str(r.Order_Ts)[:10]) for r in d.orders.collect()}
    assert got == {"o1": ("ann", 100, "2026-01-06"), None: ("bob", 100, "2026-01-05"), "o2": ("No Username", 5, "2026-01-05")}
    assert d.orders.count() == 3 and d.lines.count() == 6


def test_session_time_zone_must_be_utc(spark):
    from tests.fixtures import LINE_SCHEMA, labels

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="time zone"):
            LoyaltyData(spark.createDataFrame([], LINE_SCHEMA), labels(spark))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reexported_orders_are_current_once(spark, tmp_path):
    src = tmp_path / "exports"
    src.mkdir()
    header = HEADER + ["Note"]  # one column more than the datasets need
    _csv(src / "e1.csv", [header] + [r + ["a"] for r in ROWS[:2]])
    with open(tmp_path / "labels.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(LABELS)
    labels = read_labels(spark, str(tmp_path / "labels.csv"))
    start_order_line_ingest(spark, str(src), labels, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    _csv(src / "e2.csv", [header] + [r + ["b"] for r in ROWS])
    start_order_line_ingest(spark, str(src), labels, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    now = current_order_lines(spark, str(tmp_path / "out")).collect()
    assert len(now) == 4 and {r.Note for r in now} == {"b"}


def test_every_loyal_buyer_is_in_the_funnel_charts(spark):
    from loyalframe.operators.feeds_funnel import monthly_funnel_stack, switcher_share_by_month

    mfg = spark.createDataFrame([("2026-01", "Start with Kinka", 3), ("2026-01", "Not buy any of 3 brands", 2)],
                                "Month string, Funnel_Group string, Num_of_Customers long")
    r = monthly_funnel_stack(mfg).first()
    assert r.Total == 5 and r.Other == 2
    assert switcher_share_by_month(mfg).first().Cohort_Size == 5


def test_funnel_needs_three_brands():
    from loyalframe.config import LoyaltyConfig

    with pytest.raises(ValueError, match="3 brands"):
        LoyaltyConfig(funnel_brands=("Kinka", "Revy"))


def _export(path, header, rows, description=None):
    with open(path, "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows([header, *([description] if description else []), *rows])


def test_exports_are_read_by_header_name(spark, tmp_path):
    # the second export swaps two columns, lacks none, and has one more; the third has a BOM and blank lines' worth of cells
    swap = list(HEADER)
    q, a = swap.index("Quantity"), swap.index("Order Amount")
    swap[q], swap[a] = swap[a], swap[q]
    other = [[*r[:q], "900", "3", *r[a + 1:], "note"] for r in [ROWS[0]]]
    other[0][0] = "o9"
    _export(tmp_path / "a.csv", HEADER, ROWS)
    _export(tmp_path / "b.csv", [*swap, "Note"], other)
    _export(tmp_path / "c.csv", ["﻿Order ID", *HEADER[1:]], [["o7", *ROWS[0][1:]]])
    got = {r.Order_ID: r for r in read_order_lines(spark, str(tmp_path)).collect()}
    assert set(got) == {"o1", "o2", "o3", "o7", "o9"}
    assert (got["o9"].Quantity, got["o9"].Order_Amount, got["o9"].Note) == (3, 900, "note")
    assert (got["o2"].Quantity, got["o2"].Order_Amount, got["o2"].Note) == (1, 90, None)


def test_required_and_double_columns_are_errors_with_the_file(spark, tmp_path):
    _export(tmp_path / "good.csv", HEADER, ROWS)
    _export(tmp_path / "short.csv", [h for h in HEADER if h != "Quantity"], [])
    with pytest.raises(ValueError, match="short.csv: no column Quantity"):
        read_order_lines(spark, str(tmp_path))
    _export(tmp_path / "short.csv", [*HEADER, "order-id"], [])
    with pytest.raises(ValueError, match="short.csv: column twice"):
        read_order_lines(spark, str(tmp_path))


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    _export(tmp_path / "a.csv", [*HEADER, "Note\nof buyer"], [[*ROWS[0], "first\nsecond, \"third\""], [*ROWS[2], ""]])
    rows = read_order_lines(spark, str(tmp_path / "a.csv")).orderBy("Order_ID").collect()
    assert len(rows) == 2 and rows[0][HEADER.index("Buyer Username")] == "ann"
    assert "first\nsecond, \"third\"" in list(rows[0]) and rows[1].Order_Amount == 90


def test_no_line_is_lost_and_bad_cells_go_to_quarantine(spark, tmp_path):
    from loyalframe.sources.ingest import quarantined_cells, read_raw_export, split_order_lines

    blank = ["1", "Đã hoàn tất", "Normal", "", "ann", "K1", "", "", "", "", "", ""]  # order 1: no time, no numbers
    wordy = ["Platform order ID", "Status", "Type", "Time", "Buyer", "Product", "Pieces", "", "", "", "", ""]
    bad = ["o5", "x", "", "2026-13-45", "bob", "K1", "two", "1.5", "1", "1", "0", "1"]
    _export(tmp_path / "a.csv", HEADER, [*ROWS, blank, bad], description=wordy)
    _export(tmp_path / "b.csv", HEADER, [["nameless", *blank[1:5], "K", *blank[6:]], blank, wordy])
    _export(tmp_path / "empty.csv", HEADER, [])
    raw = read_raw_export(spark, str(tmp_path))
    split = split_order_lines(raw)
    n = [df.count() for df in split]
    assert sum(n) == raw.count() == 10 and n == [6, 1, 3]
    assert sum(r.Order_ID == "1" for r in split.lines.collect()) == 2
    cells = {(r.Order_ID, r.Column, r.Text) for r in quarantined_cells(split.quarantine).collect()}
    assert cells == {("o5", "Created_Time", "2026-13-45"), ("o5", "Quantity", "two"), ("o5", "Order_Amount", "1.5")}
    assert all(r.Export_File.endswith("a.csv") for r in split.quarantine.collect())
    assert read_order_lines(spark, str(tmp_path)).count() == 7  # a bad cell is NULL there, the line stays
    assert {r.Column: r.Num_Rejected for r in rejects(raw).collect()}["Quantity"] == 1
