"""Incremental rebuild: exports applied in turn equal one full rebuild, and touch only affected partitions."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from loyalframe.plans.pipeline import LoyaltyData
from loyalframe.plans.registry import DATASETS
from loyalframe.sources.ingest import read_labels
from loyalframe.streaming.ingest import EXPORT_FILE, EXPORT_TIME
from loyalframe.streaming.rebuild import Rebuild, start_rebuild
from tests.fixtures import LINE_SCHEMA, labels, line, t
from tests.test_io import HEADER, LABELS

NAMES = ("total_orders_data", "total_customers_data", "pivot_loyalty_tier", "monthly_customers_data",
         "pivot_monthly_customers_acquisition")


def _rows(rnd, ids, buyers):
    out = []
    for i in ids:
        when, buyer = t(f"2026-0{rnd.randint(1, 6)}-{rnd.randint(10, 28)} 10:{rnd.randint(10, 59)}"), rnd.choice(buyers)
        out += [line(f"o{i}", rnd.choice("KRSMZ"), when, buyer, amount=rnd.choice([0, 100, 250]),
                     status=rnd.choice(["Đã hủy", "Đã hoàn tất"])) for _ in range(rnd.randint(1, 3))]
    return out


def _lines(spark, rows, export):
    d = LoyaltyData(spark.createDataFrame(rows, LINE_SCHEMA), labels(spark))
    return d.lines.withColumns({EXPORT_TIME: F.lit(t(f"2026-07-0{export} 00:00")), EXPORT_FILE: F.lit(f"e{export}.csv")})


def _same(spark, tables, rows):
    full = LoyaltyData(spark.createDataFrame([r for r in rows if r[0] is not None], LINE_SCHEMA), labels(spark))
    got = tables.datasets()
    for name in NAMES:
        want = DATASETS[name](full)
        key = lambda r: tuple(str(x) for x in r)
        assert got[name].columns == want.columns
        assert sorted(map(tuple, got[name].collect()), key=key) == sorted(map(tuple, want.collect()), key=key), name


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for name in ("orders", "customers", "monthly", "order_index")
            for d, _, fs in os.walk(f"{root}/{name}") for f in fs if f.endswith(".parquet")}


def test_exports_in_turn_equal_a_full_rebuild(spark, tmp_path):
    rnd = random.Random(1)
    buyers = [None, None, *[f"b{i}" for i in range(12)]]
    first = _rows(rnd, range(60), buyers)
    tables = Rebuild(spark, str(tmp_path / "state"), buckets=16, spread=4, order_buckets=8)
    tables.apply(_lines(spark, first, 1), 0)
    _same(spark, tables, first)
    before = _files(tmp_path / "state")
    # the second export: order 0 has another buyer and status, orders 60 and 61 are new, a line has no order
    second = [r for r in first if r[0] != "o0"] + [line("o0", "K", t("2026-03-05 09:00"), "moved", amount=70)]
    second += _rows(rnd, (60, 61), ["b1", None]) + [line(None, "K", t("2026-03-05 09:00"), "b1")]
    only_changed = [r for r in second if r[0] in ("o0", "o60", "o61", None)]
    tables.apply(_lines(spark, only_changed, 2), 1)
    _same(spark, tables, second)
    after = _files(tmp_path / "state")
    kept = [f for f in before if after.get(f) == before[f]]
    touched = {f.split("/")[-3] + "/" + f.split("/")[-2] for f in after if f not in before}
    assert len(kept) > len(before) / 3 and len([x for x in touched if x.startswith("orders/")]) <= 4
    # the whole second export gives the same; so does a batch run again, and an older export changes nothing
    tables.apply(_lines(spark, second, 3), 2)
    tables.apply(_lines(spark, second, 3), 2)
    tables.apply(_lines(spark, first, 1), 3)
    _same(spark, tables, second)
    assert spark.read.parquet(f"{tmp_path}/state/batches/1/lines_without_order").count() == 1


def test_only_affected_partitions_are_scanned(spark, tmp_path):
    rows = _rows(random.Random(2), range(40), [f"b{i}" for i in range(12)])
    tables = Rebuild(spark, str(tmp_path / "state"), buckets=16, spread=4, order_buckets=8)
    tables.apply(_lines(spark, rows, 1), 0)
    plan = tables.table("orders", [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Buyer_Bucket" in plan or "PartitionFilters: [Buyer_Bucket" in plan
    seen = {r[0] for r in tables.table("orders", [3, 5]).select("Buyer_Bucket").distinct().collect()}
    assert seen <= {3, 5}


def test_a_batch_cut_short_is_repeated_from_its_folder(spark, tmp_path, monkeypatch):
    rows = _rows(random.Random(3), range(30), [None, *[f"b{i}" for i in range(5)]])
    tables = Rebuild(spark, str(tmp_path / "state"), buckets=8, spread=2, order_buckets=4)
    tables.apply(_lines(spark, rows[:20], 1), 0)
    whole = Rebuild._overwrite
    calls = []

    def fails(self, name, staged):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("executor lost")
        whole(self, name, staged)

    monkeypatch.setattr(Rebuild, "_overwrite", fails)
    with pytest.raises(RuntimeError):
        tables.apply(_lines(spark, rows, 2), 1)
    monkeypatch.setattr(Rebuild, "_overwrite", whole)
    tables.apply(_lines(spark, rows, 2), 1)
    _same(spark, tables, rows)


def test_stream_of_exports(spark, tmp_path):
    src = tmp_path / "exports"
    src.mkdir()
    with open(tmp_path / "labels.csv", "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh).writerows(LABELS)
    known = read_labels(spark, str(tmp_path / "labels.csv"))
    row = ["o1", "Đã hoàn tất", "Normal", "05/01/2026 10:00:31", "ann", "K1", "2", "200", "100", "200", "0", "200"]

    def run(name, rows):
        with open(src / name, "w", newline="", encoding="utf-8") as fh:
            csv.writer(fh).writerows([HEADER, *rows])
        start_rebuild(spark, str(src), known, str(tmp_path / "state"), str(tmp_path / "ckpt"), buckets=4, spread=2,
                      order_buckets=2).awaitTermination(180)

    run("e1.csv", [row])
    run("e2.csv", [[*row[:1], "Đã hủy", *row[2:]], ["o2", *row[1:]]])
    got = {r.Buyer_Username: (r.Num_of_Orders, r.Num_of_Canceled_Orders) for r in
           Rebuild(spark, str(tmp_path / "state"), 4, 2, 2).datasets()["total_customers_data"].collect()}
    assert got == {"ann": (2, 1)}
