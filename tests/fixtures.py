"""Hand-made order lines and labels (FIXTURES.md §3, §4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

LINE_SCHEMA = T.StructType([
    T.StructField("Order_ID", T.StringType()),
    T.StructField("SKU_ID", T.StringType()),
    T.StructField("Order_Status", T.StringType()),
    T.StructField("Normal_Or_Pre_order", T.StringType()),
    T.StructField("Created_At", T.TimestampType()),
    T.StructField("Buyer_Username", T.StringType()),
    T.StructField("Quantity", T.LongType()),
    T.StructField("Order_Amount", T.LongType()),
    T.StructField("SKU_Unit_Original_Price", T.LongType()),
    T.StructField("SKU_Subtotal_Before_Discount", T.LongType()),
    T.StructField("SKU_Seller_Discount", T.LongType()),
    T.StructField("SKU_Subtotal_After_Discount", T.LongType()),
])
LABEL_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Sub_category", T.StringType()),
    T.StructField("Product_SKU_Name", T.StringType()),
    T.StructField("Product_Variant", T.StringType()),
    T.StructField("Brand", T.StringType()),
    T.StructField("Pack_Size", T.LongType()),
])

BRAND_OF = {"K": "Kinka", "R": "Revy", "S": "SiMee", "M": "Y tế"}


def labels(spark):
    rows = [(k, "Care", f"sub-{k}", f"name-{k}", "v1", b, 10) for k, b in BRAND_OF.items()]
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def line(order_id, sku, when, buyer, amount=100, status="Đã hoàn tất", normal="Normal", qty=1, before=100,
         after=100, price=100, disc=0):
    return (order_id, sku, status, normal, when, buyer, qty, amount, price, before, disc, after)


def t(s: str) -> dt.datetime:
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M") if " " in s else dt.datetime.strptime(s, "%Y-%m-%d")


X = "Đã hủy"
# buyer -> [(time, cancelled?, brands, amount)]
CUSTOMER_ORDERS = {
    "t_aff": [("2026-01-05 10:00", False, "K", 0), ("2026-02-05 10:00", False, "K", 0)],
    "t_affx": [("2026-01-05 10:00", True, "-", 0)],
    "t_canc": [("2026-01-05 10:00", True, "R", 100)],
    "t_29": [("2026-01-05 10:00", True, "K", 100), ("2026-01-05 10:29", False, "K", 100)],
    "t_30": [("2026-01-05 10:00", True, "K", 100), ("2026-01-05 10:30", False, "K", 100)],
    "t_fast": [("2026-01-05 10:00", False, "S", 100), ("2026-01-05 10:05", False, "S", 100)],
    "t_one": [("2026-01-31 23:59", False, "M", 100)],
    "f_k_r": [("2026-01-01", False, "M", 100), ("2026-01-03", False, "K", 100),
              ("2026-01-06 12:00", False, "R", 101)],
    "f_kr": [("2026-02-01", False, "KR", 100), ("2026-03-01", False, "K", 100)],
    "f_kr_s": [("2026-02-01", False, "KR", 100), ("2026-02-11", False, "S", 100)],
    "f_s_kr": [("2026-02-01", False, "S", 100), ("2026-02-03", False, "KR", 100)],
    "f_ks": [("2026-02-01", False, "KS", 100), ("2026-02-02", False, "KS", 100)],
    "f_rs_k": [("2026-02-01", False, "RS", 100), ("2026-02-02", False, "K", 100)],
    "f_krs": [("2026-02-01", False, "KRS", 100), ("2026-04-01", False, "M", 100)],
    "f_none": [("2026-02-01", False, "M", 100), ("2026-03-01", False, "-", 100)],
    None: [("2026-02-01", False, "R", 100), ("2026-03-01", False, "R", 100)],
}


def customer_lines(spark):
    rows, n = [], 0
    for buyer, orders in CUSTOMER_ORDERS.items():
        for when, cancelled, brands, amount in orders:
            n += 1
            for b in brands:
                sku = "Z" if b == "-" else b
                rows.append(line(f"o{n}", sku, t(when), buyer, amount=amount, status=X if cancelled else "Đã hoàn tất"))
    return spark.createDataFrame(rows, LINE_SCHEMA)


# expected per buyer: orders, cancelled, APV, tier, group, status, days to switch
EXPECTED_CUSTOMERS = {
    "No Username": (2, 0, 100, "Regular / Loyal", "Only with Revy", "Non-switcher", None),
    "f_k_r": (3, 0, 100, "Regular / Loyal", "Start with Kinka", "Switcher", 5.5),
    "f_kr": (2, 0, 100, "Regular / Loyal", "Start with Kinka and Revy", "Non-switcher", None),
    "f_kr_s": (2, 0, 100, "Regular / Loyal", "Start with Kinka and Revy", "Switcher", 10.0),
    "f_krs": (2, 0, 100, "Regular / Loyal", "Start with Kinka and Revy", "Switcher", 0.0),
    "f_ks": (2, 0, 100, "Regular / Loyal", "Start with Kinka and SiMee", "Non-switcher", None),
    "f_none": (2, 0, 100, "Regular / Loyal", "Not buy any of 3 brands", "Not buy any of 3 brands", None),
    "f_rs_k": (2, 0, 100, "Regular / Loyal", "Start with Revy and SiMee", "Switcher", 1.0),
    "f_s_kr": (2, 0, 100, "Regular / Loyal", "Start with SiMee", "Switcher", 2.0),
    "t_29": (2, 1, 100, "Confused One-Time Buyer", "Only with Kinka", "Non-switcher", None),
    "t_30": (2, 1, 100, "Regular / Loyal", "Only with Kinka", "Non-switcher", None),
    "t_aff": (2, 0, 0, "Affiliator", "Only with Kinka", "Non-switcher", None),
    "t_affx": (1, 1, 0, "Affiliator", "Not buy any of 3 brands", "Not buy any of 3 brands", None),
    "t_canc": (1, 1, 100, "Canceled/No Purchases", "Only with Revy", "Non-switcher", None),
    "t_fast": (2, 0, 100, "Regular / Loyal", "Only with SiMee", "Non-switcher", None),
    "t_one": (1, 0, 100, "One-Time Buyer", "Not buy any of 3 brands", "Not buy any of 3 brands", None),
}

EXPECTED_RETENTION = [
    ("2026-01", 8, 0, 0, None),
    ("2026-02", 8, 8, 1, 12.5),
    ("2026-03", 0, 16, 3, 18.75),
    ("2026-04", 0, 16, 1, 6.25),
]
