"""Work per row: the same values by cheaper ways, and no step done more often than needed."""

import glob
import os
from decimal import Decimal

from pyspark.sql import functions as F

from loyalframe.functions import pct, round_div
from loyalframe.plans import round_trips as rt
from loyalframe.plans.pipeline import LoyaltyData
from loyalframe.plans.registry import DATASETS, EXPORTED
from loyalframe.session import apply_session_conf
from loyalframe.sources import ingest

SF = "/root/testdata/sf0.001"


def test_plain_whole_numbers_need_no_decimal(spark):
    texts = ["200", "200.0", " 200.0 ", "-3", "-0", "+7", "007", "1e3", "1E-1", "200.", ".0", "200.00", "200.5", "200.0000001", "", " ", "n/a",
             "2kg", "1,000", "--5", "9223372036854775807", "9223372036854775808", "-9223372036854775808.0", "1" * 40, "NaN", "\t5", "5.0.0", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    exact = F.trim("c").try_cast("decimal(38,6)")
    was = F.when(exact.try_cast("bigint").cast("decimal(38,6)") == exact, exact.try_cast("bigint"))
    rows = df.select("c", ingest._number("c", "bigint").alias("now"), was.alias("was")).collect()
    assert [(r.c, r.now) for r in rows] == [(r.c, r.was) for r in rows]
    assert {r.c: r.now for r in rows}["200.0"] == 200


def test_small_ratios_are_exact_and_not_decimal(spark):
    top = 2**63 - 1
    pairs = [(1, 800), (-1, 800), (5, 1000), (-5, 1000), (0, 3), (7, 0), (7, -2), (None, 1), (1, None), (10**13, 3), (10**15, 7), (-10**15, 7),
             (10**15 + 1, 7), (top, 1), (-top, 3), (1, top), (10**17, 10**17), (1, 10**17 + 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for scale in (0, 2):
        rows = df.select("a", "b", round_div("a", "b", scale).alias("r"), pct("a", "b", scale).alias("p")).collect()
        for r in rows:
            for got, times in ((r.r, 1), (r.p, 100)):
                if r.a is None or r.b is None or r.b == 0:
                    assert got is None
                elif r.b > 0:
                    n = abs(r.a) * times
                    mag = (n * 2 * 10**scale + r.b) // (2 * r.b)
                    if mag < 2**63:  # the quotient is a bigint
                        assert got == float(Decimal(-mag if r.a < 0 else mag)) / 10**scale


def test_large_generated_methods_are_not_left_interpreted(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    apply_session_conf(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_faults_are_found_without_arrays_on_good_lines(spark):
    names = ["Order_ID", "SKU_ID", "Created_Time", "Quantity", *ingest.MONEY_COLUMNS]
    good = ("o1", "7", "01/02/1996 03:04:05", "2.0", "1", "2", "3", "4", "5")
    rows = [(*good, False), ("o2", "7", "no time", "n/a", "1", "2", "", None, "5", False), ("o3", None, None, None, *[None] * 5, False),
            ("Platform id", "", "Time", "", *[""] * 5, True)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + f", {ingest.IS_DESCRIPTION} boolean")
    split = ingest.split_order_lines(raw)
    assert sorted(r.Order_ID for r in split.lines.collect()) == ["o1", "o3"]
    bad = split.quarantine.collect()
    assert [(r.Order_ID, [(x.Column, x.Text) for x in r.Rejected]) for r in bad] == [("o2", [("Created_Time", "no time"), ("Quantity", "n/a")])]
    assert split.descriptions.count() == 1
    plan = split.lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Rejected" not in plan and "array(" not in plan


def test_buyers_are_aggregated_once_for_all_exports(spark, monkeypatch):
    made = []
    real = LoyaltyData.by_buyer
    monkeypatch.setattr(LoyaltyData, "by_buyer", lambda self, build: made.append(1) or real(self, build))
    d = LoyaltyData.from_tables(spark, SF)
    counts = {r.Dataset: r.Num_Rows for r in rt.exported_row_counts(d, {n: DATASETS[n] for n in EXPORTED}).collect()}
    assert set(counts) == set(EXPORTED) and counts["pivot_loyalty_tier"] > 0
    plan = d.customers._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # read from the written buyers
    assert len(made) == 2  # buyers and months


def test_labelled_csv_is_written_compressed_and_read_back_whole(spark, monkeypatch):
    paths = []
    real = rt.write_labelled_csv
    monkeypatch.setattr(rt, "write_labelled_csv", lambda df, path, **kw: paths.append(path) or real(df, path, **kw))
    d = LoyaltyData.from_tables(spark, SF)
    got, want = rt.labelled_csv_read_back(d), DATASETS["label_order_lines"](d)
    assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
    files = glob.glob(os.path.join(paths[0].removeprefix("file:"), "part-*"))
    assert files and all(f.endswith(".csv.gz") for f in files)
