"""Independent DuckDB statements of every dataset (the correctness oracle).

Each statement starts from the same table adapter as the Spark side
(written here again as SQL) and restates the dataset rules directly in
SQL. Rounding follows the engine's exact-integer rule: ``rdiv(p, q, s)``
is ``round(p / q, s)`` half away from zero on integers.
"""

from __future__ import annotations

BRANDS = (("Kinka", "Kinka"), ("Revy", "Revy"), ("SiMee", "SiMee"), ("Y tế", "Medical"), ("IONCare", "IONCare"))
SFX = [s for _, s in BRANDS]
N = [f"Basket_Num_{s}_Products" for s in SFX]
S = [f"Basket_{s}_Spend_Amnt" for s in SFX]
K = [f"Basket_Total_{s}_Packsize" for s in SFX]


def rdiv(p: str, q: str, s: int) -> str:
    two_k = 2 * 10**s
    hp, hq = f"CAST(({p}) AS HUGEINT)", f"CAST(({q}) AS HUGEINT)"
    return (f"(CASE WHEN {hp} < 0 THEN -1 ELSE 1 END * ((abs({hp}) * {two_k} + {hq}) // (2 * NULLIF({hq}, 0)))"
            f" / {10**s}::DOUBLE)")


def rdiv_even(p: str, q: str, s: int) -> str:
    n, hq = f"(CAST(({p}) AS HUGEINT) * {10**s})", f"NULLIF(CAST(({q}) AS HUGEINT), 0)"
    base = f"({n} // {hq})"
    rem2 = f"(({n} - {base} * {hq}) * 2)"
    return (f"(({base} + CASE WHEN {rem2} > {hq} OR ({rem2} = {hq} AND {base} % 2 = 1) THEN 1 ELSE 0 END)"
            f" / {10**s}::DOUBLE)")


def pct(p: str, q: str, s: int = 2) -> str:
    return rdiv(f"CAST(({p}) AS HUGEINT) * 100", q, s)


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def minute(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M')"


def month(x: str) -> str:
    return f"strftime({x}, '%Y-%m')"


def mins(later: str, earlier: str) -> str:
    return f"date_diff('minute', {earlier}, {later})"


ADAPTER = """
order_lines AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS Order_ID,
    CAST(l.l_partkey AS VARCHAR) AS SKU_ID,
    CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 = 0 THEN 'Đã hủy' ELSE 'Đã hoàn tất' END AS Order_Status,
    CASE WHEN l.l_linenumber % 5 = 0 THEN NULL ELSE 'Normal' END AS Normal_Or_Pre_order,
    o.o_orderdate + INTERVAL '1' MINUTE * CAST(o.o_orderkey % 1440 AS INT) AS Created_At,
    CASE WHEN o.o_custkey % 97 = 0 THEN NULL
         ELSE concat('cust_', CAST(o.o_custkey AS VARCHAR), '_', CAST(o.o_orderkey % 8 AS VARCHAR)) END AS Buyer_Username,
    CAST(l.l_quantity AS BIGINT) AS Quantity,
    CAST(CASE WHEN o.o_custkey % 13 = 0 THEN 0 ELSE ROUND(o.o_totalprice * 100) END AS BIGINT) AS Order_Amount,
    CAST(ROUND(p.p_retailprice * 100) AS BIGINT) AS SKU_Unit_Original_Price,
    CAST(CASE WHEN l.l_partkey % 17 = 0 THEN 0 ELSE ROUND(l.l_extendedprice * 100) END AS BIGINT) AS SKU_Subtotal_Before_Discount,
    CAST(ROUND(l.l_extendedprice * l.l_discount * 100) AS BIGINT) AS SKU_Seller_Discount,
    CAST(CASE WHEN l.l_partkey % 17 = 0 THEN 0
         ELSE ROUND(l.l_extendedprice * 100) - ROUND(l.l_extendedprice * l.l_discount * 100) END AS BIGINT) AS SKU_Subtotal_After_Discount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
),
product_labels AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ID, p_type AS Category,
    concat(p_type, '/', CAST(p_size % 5 AS VARCHAR)) AS Sub_category,
    p_name AS Product_SKU_Name, p_brand AS Product_Variant,
    CASE WHEN p_partkey % 10 < 4 THEN 'Kinka' WHEN p_partkey % 10 < 6 THEN 'Revy'
         WHEN p_partkey % 10 = 6 THEN 'SiMee' WHEN p_partkey % 10 = 7 THEN 'Y tế' ELSE 'IONCare' END AS Brand,
    CAST(p_size AS BIGINT) AS Pack_Size
  FROM part WHERE p_partkey % 10 <> 9
)"""

LINES = """
lines AS (
  SELECT ol.Order_ID, ol.SKU_ID, ol.Order_Status, ol.Normal_Or_Pre_order, ol.Created_At, ol.Buyer_Username,
    ol.Quantity, ol.Order_Amount, ol.SKU_Unit_Original_Price, ol.SKU_Subtotal_Before_Discount,
    ol.SKU_Seller_Discount, ol.SKU_Subtotal_After_Discount,
    CASE WHEN ol.SKU_Subtotal_Before_Discount = 0 AND ol.Normal_Or_Pre_order IS NOT NULL THEN 'Quà tặng'
         ELSE lb.Category END AS Category,
    lb.Sub_category, lb.Product_SKU_Name, lb.Product_Variant, lb.Brand, lb.Pack_Size
  FROM order_lines ol LEFT JOIN product_labels lb ON trim(ol.SKU_ID) = trim(lb.ID) AND trim(lb.ID) <> ''
)"""

_o_brand = ",\n    ".join(
    [f"COUNT(CASE WHEN Brand = '{b}' THEN 1 END) AS {n}" for (b, _), n in zip(BRANDS, N)]
    + [f"{isum(f'CASE WHEN Brand = {chr(39)}{b}{chr(39)} THEN SKU_Subtotal_After_Discount END')} AS {s}"
       for (b, _), s in zip(BRANDS, S)]
    + [f"{isum(f'CASE WHEN Brand = {chr(39)}{b}{chr(39)} THEN Pack_Size END')} AS {k}" for (b, _), k in zip(BRANDS, K)]
)
ORDERS = f"""
orders_t AS (
  SELECT Order_ID, MAX(Order_Amount) AS Order_Amount, MAX(Order_Status) AS Order_Status,
    MAX(date_trunc('minute', Created_At)) AS Order_Ts,
    COALESCE(MAX(Buyer_Username), 'No Username') AS Buyer_Username,
    {isum('SKU_Subtotal_After_Discount')} AS Sum_SKU_Subtotal_After_Discount,
    {isum('SKU_Subtotal_After_Discount')} - MAX(Order_Amount) AS Different_Amount,
    {_o_brand}
  FROM lines GROUP BY Order_ID
)"""

_sums = ",\n    ".join(f"{isum(c)} AS {c}" for c in N + S + K)
_total = " + ".join(N)
FK, FR, FS = "FT_Kinka", "FT_Revy", "FT_SiMee"


# funnel rules restated on flags: which brands were bought at the very first
# brand purchase (k1 / r1 / s1), and which brands were ever bought
FIRST = f"least({FK}, {FR}, {FS})"

FUNNEL = """CASE
      WHEN first_any IS NULL THEN 'Not buy any of 3 brands'
      WHEN n_seen = 1 AND k_seen THEN 'Only with Kinka'
      WHEN n_seen = 1 AND r_seen THEN 'Only with Revy'
      WHEN n_seen = 1 THEN 'Only with SiMee'
      WHEN k1 AND r1 THEN 'Start with Kinka and Revy'
      WHEN k1 AND s1 THEN 'Start with Kinka and SiMee'
      WHEN r1 AND s1 THEN 'Start with Revy and SiMee'
      WHEN k1 THEN 'Start with Kinka'
      WHEN r1 THEN 'Start with Revy'
      ELSE 'Start with SiMee' END"""

# brands in the entry set implied by the group name
IN_ENTRY = {"k": "Funnel_Group IN ('Start with Kinka', 'Start with Kinka and Revy', 'Start with Kinka and SiMee')",
            "r": "Funnel_Group IN ('Start with Revy', 'Start with Kinka and Revy', 'Start with Revy and SiMee')",
            "s": "Funnel_Group IN ('Start with SiMee', 'Start with Kinka and SiMee', 'Start with Revy and SiMee')"}

STATUS = f"""CASE
      WHEN Funnel_Group = 'Not buy any of 3 brands' THEN Funnel_Group
      WHEN Funnel_Group LIKE 'Only with %' THEN 'Non-switcher'
      WHEN (k_seen AND NOT {IN_ENTRY['k']}) OR (r_seen AND NOT {IN_ENTRY['r']}) OR (s_seen AND NOT {IN_ENTRY['s']})
        THEN 'Switcher'
      ELSE 'Non-switcher' END"""

SWITCH_TIME = f"""CASE WHEN Switching_Status = 'Switcher' THEN least(
      CASE WHEN NOT {IN_ENTRY['k']} THEN {FK} END,
      CASE WHEN NOT {IN_ENTRY['r']} THEN {FR} END,
      CASE WHEN NOT {IN_ENTRY['s']} THEN {FS} END) END"""

TIER = """CASE
      WHEN Num_of_Orders >= 1 AND Total_Customer_Spending = 0 THEN 'Affiliator'
      WHEN Num_of_Orders - Num_of_Canceled_Orders = 0 THEN 'Canceled/No Purchases'
      WHEN Retention_Time_Period < 0.0208::DOUBLE AND Num_of_Orders >= 2
        AND Num_of_Orders - Num_of_Canceled_Orders >= 1 AND Num_of_Canceled_Orders <> 0 THEN 'Confused One-Time Buyer'
      WHEN Num_of_Orders >= 2 THEN 'Regular / Loyal'
      WHEN Num_of_Orders = 1 THEN 'One-Time Buyer'
      ELSE 'Unsorted' END"""

_bpct = ",\n    ".join(f"{pct(n, 'Basket_Total_Num_Products')} AS Basket_Pct_{s}_Products" for s, n in zip(SFX, N))

CUSTOMERS = f"""
cust_a AS (
  SELECT Buyer_Username, COUNT(Order_ID) AS Num_of_Orders,
    COUNT(CASE WHEN Order_Status = 'Đã hủy' THEN 1 END) AS Num_of_Canceled_Orders,
    MIN(Order_Ts) AS First_Seen_Ts, MAX(Order_Ts) AS Last_Seen_Ts,
    {isum('Order_Amount')} AS Total_Customer_Spending,
    {isum('Sum_SKU_Subtotal_After_Discount')} AS Merchandise_Value,
    {_sums},
    MIN(CASE WHEN Basket_Num_Kinka_Products > 0 THEN Order_Ts END) AS {FK},
    MIN(CASE WHEN Basket_Num_Revy_Products > 0 THEN Order_Ts END) AS {FR},
    MIN(CASE WHEN Basket_Num_SiMee_Products > 0 THEN Order_Ts END) AS {FS}
  FROM orders_t GROUP BY Buyer_Username
),
cust_b AS (
  SELECT *, {mins('Last_Seen_Ts', 'First_Seen_Ts')} AS Retention_Minutes,
    CAST(Total_Customer_Spending // NULLIF(Num_of_Orders, 0) AS BIGINT) AS Average_Purchase_Value,
    {_total} AS Basket_Total_Num_Products
  FROM cust_a
),
cust_c AS (
  SELECT *, CAST(Retention_Minutes AS DOUBLE) / 1440 AS Retention_Time_Period,
    {rdiv('Basket_Total_Num_Products', 'Num_of_Orders', 2)} AS Avg_Basket_Size,
    {_bpct}
  FROM cust_b
),
cust_flags AS (
  SELECT *, {FIRST} AS first_any,
    {FK} IS NOT NULL AS k_seen, {FR} IS NOT NULL AS r_seen, {FS} IS NOT NULL AS s_seen,
    CAST({FK} IS NOT NULL AS INTEGER) + CAST({FR} IS NOT NULL AS INTEGER) + CAST({FS} IS NOT NULL AS INTEGER) AS n_seen,
    COALESCE({FK} = {FIRST}, false) AS k1, COALESCE({FR} = {FIRST}, false) AS r1,
    COALESCE({FS} = {FIRST}, false) AS s1
  FROM cust_c
),
cust_d AS (SELECT *, {TIER} AS Loyalty_Tier, {FUNNEL} AS Funnel_Group FROM cust_flags),
cust_e AS (SELECT *, {STATUS} AS Switching_Status FROM cust_d),
cust_f AS (SELECT *, {SWITCH_TIME} AS Switching_Ts FROM cust_e),
cust AS (SELECT *, {rdiv(mins('Switching_Ts', 'First_Seen_Ts'), '1440', 2)} AS Days_To_Switch FROM cust_f)"""

CUSTOMER_COLS = ", ".join([
    "Buyer_Username", "Num_of_Orders", "Num_of_Canceled_Orders",
    f"{minute('First_Seen_Ts')} AS First_Seen", f"{minute('Last_Seen_Ts')} AS Last_Seen",
    "Retention_Time_Period", "Total_Customer_Spending", "Merchandise_Value", "Average_Purchase_Value",
    *N, "Basket_Total_Num_Products", "Avg_Basket_Size", *S, *K,
    f"{minute(FK)} AS First_Time_Purchase_Kinka", f"{minute(FR)} AS First_Time_Purchase_Revy",
    f"{minute(FS)} AS First_Time_Purchase_SiMee",
    *[f"Basket_Pct_{s}_Products" for s in SFX],
    "Loyalty_Tier", "Funnel_Group", "Switching_Status", f"{minute('Switching_Ts')} AS Switching_Time",
    "Days_To_Switch",
])

_msums = _sums
MONTHLY = f"""
mon_a AS (
  SELECT {month('Order_Ts')} AS Order_Month, Buyer_Username, COUNT(Order_ID) AS Num_of_Orders,
    COUNT(CASE WHEN Order_Status = 'Đã hủy' THEN 1 END) AS Num_of_Canceled_Orders,
    MIN(Order_Ts) AS First_Seen_In_Month_Ts, MAX(Order_Ts) AS Last_Seen_In_Month_Ts,
    {isum('Order_Amount')} AS Total_Customer_Spending,
    {isum('Sum_SKU_Subtotal_After_Discount')} AS Merchandise_Value,
    {_msums}
  FROM orders_t GROUP BY 1, 2
),
mon_b AS (
  SELECT *, MIN(First_Seen_In_Month_Ts) OVER (PARTITION BY Buyer_Username) AS Lifetime_First_Seen_Ts,
    MAX(Last_Seen_In_Month_Ts) OVER (PARTITION BY Buyer_Username) AS Lifetime_Last_Seen_Ts,
    CAST(Total_Customer_Spending // NULLIF(Num_of_Orders, 0) AS BIGINT) AS Average_Purchase_Value,
    {_total} AS Basket_Total_Num_Products
  FROM mon_a
),
mon AS (
  SELECT *, {rdiv('Basket_Total_Num_Products', 'Num_of_Orders', 2)} AS Avg_Basket_Size,
    {mins('Last_Seen_In_Month_Ts', 'least(First_Seen_In_Month_Ts, Lifetime_First_Seen_Ts)')} AS Retention_Minutes,
    CAST({mins('Last_Seen_In_Month_Ts', 'least(First_Seen_In_Month_Ts, Lifetime_First_Seen_Ts)')} AS DOUBLE) / 1440
      AS Retention_Time_Period,
    {_bpct},
    CASE WHEN {month('Lifetime_First_Seen_Ts')} < {month('First_Seen_In_Month_Ts')}
      THEN 'Return From Previous Month' ELSE 'Newly Accquired' END AS Acquisition_Type
  FROM mon_b
)"""

MONTHLY_COLS = ", ".join([
    "Order_Month", "Buyer_Username", "Num_of_Orders", "Num_of_Canceled_Orders",
    f"{minute('Lifetime_First_Seen_Ts')} AS Lifetime_First_Seen",
    f"{minute('First_Seen_In_Month_Ts')} AS First_Seen_In_Month",
    f"{minute('Lifetime_Last_Seen_Ts')} AS Lifetime_Last_Seen",
    f"{minute('Last_Seen_In_Month_Ts')} AS Last_Seen_In_Month",
    "Total_Customer_Spending", "Merchandise_Value", "Average_Purchase_Value",
    *N, "Basket_Total_Num_Products", "Avg_Basket_Size", *S, *K, "Retention_Time_Period",
    *[f"Basket_Pct_{s}_Products" for s in SFX], "Acquisition_Type",
])

BASE = "WITH " + ",".join([ADAPTER, LINES, ORDERS, CUSTOMERS, MONTHLY])


def q(body: str) -> str:
    return BASE + "\n" + body


def _segment(keys: str, part: str, extra: str, with_orders: bool) -> str:
    tot = " + ".join(f"SUM({n})" for n in N)
    cols = [
        f"{keys}",
        "COUNT(Buyer_Username) AS Num_Of_Customers",
        f"{pct('COUNT(Buyer_Username)', f'SUM(COUNT(Buyer_Username)) OVER ({part})')} AS Pct_Num_Of_Customers",
        f"{isum('Total_Customer_Spending')} AS Total_Customer_Spending",
        f"{pct('SUM(Total_Customer_Spending)', f'SUM(SUM(Total_Customer_Spending)) OVER ({part})')}"
        " AS Pct_Total_Customer_Spending",
        *([f"{isum('Num_of_Orders')} AS Num_of_Orders"] if with_orders else []),
        "CAST(SUM(Total_Customer_Spending) // NULLIF(SUM(Num_of_Orders), 0) AS BIGINT) AS Average_Purchase_Value",
        f"{rdiv('SUM(Num_of_Canceled_Orders)', 'COUNT(*)', 2)} AS Avg_Num_of_Canceled_Orders",
        f"{pct('SUM(Num_of_Canceled_Orders)', 'SUM(Num_of_Orders)')} AS Cancellation_Rate",
        extra,
        *[f"{isum(c)} AS {c}" for c in N + S],
        f"CAST({tot} AS BIGINT) AS Basket_Total_Num_Products",
        f"{rdiv(tot, 'SUM(Num_of_Orders)', 2)} AS Avg_Basket_Size",
        *[f"CAST(SUM({k}) // NULLIF(SUM({n}), 0) AS BIGINT) AS Basket_Avg_{s}_Packsize" for s, n, k in zip(SFX, N, K)],
        *[f"{pct(f'SUM({n})', tot)} AS Basket_Pct_{s}_Products" for s, n in zip(SFX, N)],
        *[f"CAST(SUM({sp}) // NULLIF(SUM({n}), 0) AS BIGINT) AS Basket_Avg_Spend_On_{s}"
          for s, n, sp in zip(SFX, N, S)],
    ]
    return ",\n  ".join(cols)


PIVOT_LOYALTY = q(
    "SELECT " + _segment(
        "Loyalty_Tier", "",
        f"{rdiv('SUM(Num_of_Orders)', 'COUNT(*)', 2)} AS Avg_Num_Of_Orders, "
        "CAST(SUM(Total_Customer_Spending) // NULLIF(COUNT(Buyer_Username), 0) AS BIGINT) AS Avg_Customer_Lifetime_Value, "
        f"{rdiv('SUM(Retention_Minutes)', 'COUNT(Retention_Minutes) * 1440', 3)} AS Avg_Retention_Time_Period", False,
    ) + "\nFROM cust GROUP BY Loyalty_Tier"
)

ACQ_SELECT = (
    "SELECT " + _segment(
        "Order_Month, Acquisition_Type", "PARTITION BY Order_Month",
        "CAST(SUM(Retention_Minutes) AS DOUBLE) / CAST(NULLIF(COUNT(Retention_Minutes) * 1440, 0) AS DOUBLE)"
        " AS Retention_Time_Period, "
        f"{rdiv('SUM(Num_of_Orders)', 'COUNT(*)', 2)} AS Buying_Frequency", True,
    ) + "\nFROM mon GROUP BY Order_Month, Acquisition_Type"
)
PIVOT_ACQ = q(ACQ_SELECT)

_FUNNEL_MEASURES = ",\n  ".join([
    "COUNT(Buyer_Username) AS Num_Of_Customers",
    f"{rdiv('SUM(CAST(round(Days_To_Switch * 100) AS BIGINT))', 'COUNT(Days_To_Switch) * 100', 2)} AS Avg_Days_To_Switch",
    f"{rdiv('SUM(Total_Customer_Spending)', 'COUNT(Total_Customer_Spending)', 0)} AS Avg_Customer_Value",
    f"{rdiv('SUM(Average_Purchase_Value)', 'COUNT(Average_Purchase_Value)', 0)} AS Avg_Purchase_Value",
    f"{rdiv('SUM(Num_of_Orders)', 'COUNT(Num_of_Orders)', 2)} AS Avg_Num_Of_Orders",
    f"{rdiv('SUM(Num_of_Canceled_Orders)', 'COUNT(Num_of_Canceled_Orders)', 2)} AS Avg_Num_of_Canceled_Orders",
    f"{rdiv('SUM(Retention_Minutes)', 'COUNT(Retention_Minutes) * 1440', 2)} AS Avg_Retention_Time_Period",
    f"{rdiv('SUM(Retention_Minutes)', '(SUM(Num_of_Orders) - SUM(Num_of_Canceled_Orders)) * 1440', 2)}"
    " AS Avg_Days_Between_Noncanceled_Purchases",
])

FG_SELECT = ("SELECT Funnel_Group, MAX(Switching_Status) AS Switching_Status, MAX(Loyalty_Tier) AS Loyalty_Tier,\n  "
             + _FUNNEL_MEASURES + "\nFROM cust WHERE Loyalty_Tier = 'Regular / Loyal' GROUP BY Funnel_Group")
MFG_SELECT = (f"SELECT {month('First_Seen_Ts')} AS Month, Funnel_Group, COUNT(*) AS Num_of_Customers "
              "FROM cust WHERE Loyalty_Tier = 'Regular / Loyal' GROUP BY 1, 2")

_PRODUCT_NG = "lines WHERE Category <> 'Quà tặng'"
_sub = """(SELECT {month} AS Month_Year, Product_SKU_Name, Category, Product_Variant{extra}
    FROM lines WHERE Category <> 'Quà tặng'{cond}
    GROUP BY 1, Product_SKU_Name, Category, Product_Variant)"""
PRODUCTS = q(f"""
SELECT t1.*,
  COALESCE(t2.Nonaffiliated_Num_Of_Unit_Sold, 0) AS Nonaffiliated_Num_Of_Unit_Sold,
  t1.Affiliated_Num_Of_Unit_Sold - COALESCE(t2.Nonaffiliated_Num_Of_Unit_Sold, 0) AS Num_Of_Affiliate_Sample_Unit,
  COALESCE(t2.Nonaffiliated_Volume_Sold, 0) AS Nonaffiliated_Volume_Sold,
  COALESCE(t2.Nonaffiliated_Avg_Price, 0) AS Nonaffiliated_Avg_Price
FROM (SELECT {month('Created_At')} AS Month_Year, Category, MAX(Sub_category) AS Sub_category, Product_SKU_Name,
        Product_Variant, {isum('SKU_Subtotal_After_Discount')} AS Total_Merchanise_Value,
        {isum('Quantity')} AS Affiliated_Num_Of_Unit_Sold, {isum('Pack_Size')} AS Affiliated_Volume_Sold
      FROM lines WHERE Category <> 'Quà tặng'
      GROUP BY 1, Product_SKU_Name, Category, Product_Variant) t1
LEFT JOIN (SELECT {month('Created_At')} AS Month_Year, Product_SKU_Name, Product_Variant,
        CAST(COALESCE(SUM(Quantity), 0) AS BIGINT) AS Nonaffiliated_Num_Of_Unit_Sold,
        CAST(COALESCE(SUM(Pack_Size), 0) AS BIGINT) AS Nonaffiliated_Volume_Sold,
        CAST(SUM(SKU_Subtotal_After_Discount) // NULLIF(SUM(Quantity), 0) AS BIGINT) AS Nonaffiliated_Avg_Price
      FROM lines WHERE Category <> 'Quà tặng' AND Normal_Or_Pre_order IS NOT NULL
      GROUP BY 1, Product_SKU_Name, Category, Product_Variant) t2
ON t1.Month_Year = t2.Month_Year AND t1.Product_SKU_Name = t2.Product_SKU_Name
   AND t1.Product_Variant = t2.Product_Variant""")

LINE_COLS = ("Order_ID, SKU_ID, Order_Status, Normal_Or_Pre_order, strftime(Created_At, '%d/%m/%Y %H:%M:%S') AS "
             "Created_Time, Buyer_Username, Quantity, Order_Amount, SKU_Unit_Original_Price, "
             "SKU_Subtotal_Before_Discount, SKU_Seller_Discount, SKU_Subtotal_After_Discount, Category, "
             "Sub_category, Product_SKU_Name, Product_Variant, Brand, Pack_Size")

_month_counts = """SELECT Order_Month,
    COUNT(CASE WHEN Acquisition_Type = 'Newly Accquired' THEN 1 END) AS New_Customers,
    COUNT(CASE WHEN Acquisition_Type = 'Return From Previous Month' THEN 1 END) AS Returning_Customers
  FROM mon GROUP BY Order_Month"""

ORACLE_SQL: dict[str, str] = {
    "label_order_lines": q(f"SELECT {LINE_COLS} FROM lines"),
    "missing_label_ids": q(
        "SELECT trim(SKU_ID) AS Missing_ID FROM order_lines WHERE SKU_ID IS NOT NULL AND trim(SKU_ID) NOT IN "
        "(SELECT trim(ID) FROM product_labels WHERE trim(ID) <> '')"),
    "total_orders_data": q(
        "SELECT Order_ID, Order_Amount, Order_Status, " + minute("Order_Ts") + " AS Order_Time, Buyer_Username, "
        "Sum_SKU_Subtotal_After_Discount, Different_Amount, " + ", ".join(N + S + K) + " FROM orders_t"),
    "total_customers_data": q(f"SELECT {CUSTOMER_COLS} FROM cust"),
    "filter_loyal_switching_customers": q(
        f"SELECT Buyer_Username, Loyalty_Tier, Funnel_Group, {minute('First_Seen_Ts')} AS First_Seen, "
        f"{minute('Switching_Ts')} AS Switching_Time, Days_To_Switch, Total_Customer_Spending, Num_of_Orders, "
        "Num_of_Canceled_Orders FROM cust WHERE Switching_Status = 'Switcher' AND Loyalty_Tier = 'Regular / Loyal'"),
    "pivot_loyalty_tier": PIVOT_LOYALTY,
    "monthly_customers_data": q(f"SELECT {MONTHLY_COLS} FROM mon"),
    "returning_customers": q(f"SELECT {MONTHLY_COLS} FROM mon WHERE Acquisition_Type = 'Return From Previous Month'"),
    "pivot_monthly_customers_acquisition": PIVOT_ACQ,
    "pivot_monthly_products": PRODUCTS,
    "switch_total_switching_status": q(
        "SELECT Switching_Status, COUNT(*) AS Num_of_Customers, "
        f"{pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS Pct_Num_Of_Customers "
        "FROM cust WHERE Loyalty_Tier = 'Regular / Loyal' GROUP BY Switching_Status"),
    "switch_monthly_switching_status_loyal": q(
        f"SELECT {month('First_Seen_Ts')} AS Month, Switching_Status, COUNT(Buyer_Username) AS Num_of_Customers "
        "FROM cust WHERE Loyalty_Tier = 'Regular / Loyal' GROUP BY 1, 2"),
    "switch_total_funnel_group": q(FG_SELECT),
    "switch_total_funnel_group_by_status": q(
        "SELECT Funnel_Group, Switching_Status, MAX(Loyalty_Tier) AS Loyalty_Tier,\n  "
        + _FUNNEL_MEASURES + "\nFROM cust WHERE Loyalty_Tier = 'Regular / Loyal' GROUP BY Funnel_Group, Switching_Status"),
    "switch_monthly_funnel_group": q(MFG_SELECT),
    "switch_monthly_funnel_group_switcher": q(
        f"SELECT {month('First_Seen_Ts')} AS Month, Funnel_Group, COUNT(*) AS Num_of_Customers "
        "FROM cust WHERE Loyalty_Tier = 'Regular / Loyal' AND Switching_Status = 'Switcher' GROUP BY 1, 2"),
    "monthly_sku_sales": q(
        f"SELECT Product_SKU_Name, {month('Created_At')} AS Month_Year, COUNT(*) AS Num_Of_Lines, "
        f"{isum('SKU_Subtotal_After_Discount')} AS Total_Merchandise_Value FROM lines "
        "WHERE Category <> 'Quà tặng' AND Buyer_Username <> '' GROUP BY 1, 2"),
    "loyal_status_share": q(
        "SELECT Loyalty_Tier, Switching_Status, COUNT(Buyer_Username) AS Group_Size, "
        "CAST(SUM(COUNT(Buyer_Username)) OVER () AS BIGINT) AS Total_Customers, "
        f"{pct('COUNT(Buyer_Username)', 'SUM(COUNT(Buyer_Username)) OVER ()')} AS Percentage_of_Total "
        "FROM cust WHERE Loyalty_Tier = 'Regular / Loyal' GROUP BY Loyalty_Tier, Switching_Status"),
    "entry_month_by_tier": q(
        f"SELECT {month('First_Seen_Ts')} AS Entry_Month, Loyalty_Tier, COUNT(Buyer_Username) AS Num_Of_Customers "
        "FROM cust GROUP BY 1, 2"),
    "monthly_retention_rate": q(f"""
SELECT Order_Month, New_Customers, Legacy_Pool, Returning_Customers,
  CASE WHEN Legacy_Pool > 0 THEN {rdiv_even('Returning_Customers * 100', 'Legacy_Pool', 2)} END AS Retention_Rate_Pct
FROM (SELECT *, CAST(COALESCE(SUM(New_Customers) OVER (ORDER BY Order_Month
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS Legacy_Pool
      FROM ({_month_counts}) m) x"""),
    "pool_vs_retention": q(f"""
SELECT Order_Month, Legacy_Pool, Retention_Rate FROM (
  SELECT Order_Month, Legacy_Pool,
    (CAST(NULLIF(Returning_Customers, 0) AS DOUBLE) / CAST(Legacy_Pool AS DOUBLE)) * 100.0::DOUBLE AS Retention_Rate
  FROM (SELECT *, LAG(cum, 1) OVER (ORDER BY Order_Month) AS Legacy_Pool FROM (
    SELECT *, CASE WHEN New_Customers > 0 THEN CAST(SUM(NULLIF(New_Customers, 0)) OVER (ORDER BY Order_Month
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS cum
    FROM ({_month_counts}) m) a) b) c
WHERE Retention_Rate IS NOT NULL"""),
    "second_purchase": q(f"""
SELECT Buyer_Username, {minute('Order_Ts')} AS second_purchase_date FROM (
  SELECT Buyer_Username, Order_Ts,
    ROW_NUMBER() OVER (PARTITION BY Buyer_Username ORDER BY Order_Ts, Order_ID) AS purchase_rank
  FROM orders_t) r WHERE purchase_rank = 2"""),
    "customers_active_between": q(f"""
SELECT {CUSTOMER_COLS} FROM cust c WHERE EXISTS (
  SELECT 1 FROM orders_t o WHERE o.Buyer_Username = c.Buyer_Username
    AND o.Order_Ts >= TIMESTAMP '1996-04-01 00:00:00' AND o.Order_Ts < TIMESTAMP '1996-05-01 00:00:00')"""),
    "monthly_funnel": q(f"""
SELECT t1.Month, t1.Total_Count, COALESCE(t2.Returning_Count, 0) AS Returning_Count,
  COALESCE(t3.Switching_Count, 0) AS Switching_Count
FROM (SELECT Order_Month AS Month, COUNT(Buyer_Username) AS Total_Count FROM mon GROUP BY Order_Month) t1
LEFT JOIN (SELECT Order_Month AS Month, COUNT(Buyer_Username) AS Returning_Count FROM mon
           WHERE Acquisition_Type = 'Return From Previous Month' GROUP BY Order_Month) t2 ON t1.Month = t2.Month
LEFT JOIN (SELECT {month('Switching_Ts')} AS Month, COUNT(Buyer_Username) AS Switching_Count FROM cust
           WHERE Switching_Status = 'Switcher' GROUP BY 1) t3 ON t1.Month = t3.Month"""),
    "subcategory_month_lines": q(
        f"SELECT {LINE_COLS} FROM lines WHERE Sub_category = 'MEDIUM/0' AND {month('Created_At')} = '1996-03'"),
}

# ---------------------------------------------------------------- chart feeds
FEED_BASE = (BASE + ",\nacq AS (" + ACQ_SELECT + "),\n"
             "acqk AS (SELECT *, CASE WHEN lower(Acquisition_Type) LIKE '%return%' THEN 'ret' ELSE 'new' END AS kind"
             " FROM acq),\nfg AS (" + FG_SELECT + "),\nmfg AS (" + MFG_SELECT + ")")


def f(body: str) -> str:
    return FEED_BASE + "\n" + body


def fdiv(a: str, b: str) -> str:
    return f"(CAST(({a}) AS DOUBLE) / CAST(NULLIF(({b}), 0) AS DOUBLE))"


def of(kind: str, c: str) -> str:
    return f"MAX(CASE WHEN kind = '{kind}' THEN {c} END)"


PHASE = "CASE WHEN Order_Month <= '1996-12' THEN 'P1' WHEN Order_Month <= '1999-06' THEN 'P2' ELSE 'P3' END"
ACTIVE = "HAVING SUM(Total_Customer_Spending) > 0"
SKUS = [("blue rod", "Brand#25"), ("hot gear", "Brand#25"), ("cold bolt", "Brand#5")]
NAMES = [n for n, _ in SKUS]
IN_SKUS = "(" + " OR ".join(f"(Product_SKU_Name = '{n}' AND Product_Variant = '{v}')" for n, v in SKUS) + ")"


def wk(ts: str, day: str) -> str:
    target = 8 if day == "MON" else 7
    return f"(CAST({ts} AS DATE) + CAST(({target} - isodow({ts})) % 7 AS INTEGER))"


_u = [f"COALESCE({isum(n)}, 0)" for n in N]
_s = [f"COALESCE({isum(x)}, 0)" for x in S]
_n = "COALESCE(Num_Of_Customers, 0)"
_ltv = "COALESCE(Avg_Customer_Value, 0.0)"
_sw = "lower(COALESCE(Switching_Status, '')) = 'switcher'"
_stack = ["Only with Kinka", "Start with Kinka", "Start with Kinka and Revy", "Start with Kinka and SiMee",
          "Only with Revy", "Start with Revy", "Start with Revy and SiMee", "Only with SiMee", "Start with SiMee",
          "Start with all 3 brands"]
_after_seller = ("CASE WHEN Quantity <> 0 THEN CAST(SKU_Unit_Original_Price * Quantity - SKU_Seller_Discount AS DOUBLE)"
                 " / CAST(Quantity AS DOUBLE) END")
_xmin = "date_diff('minute', TIMESTAMP '1970-01-01 00:00:00', Lifetime_First_Seen_Ts)"
_ret = ("(SELECT Order_Month, " + _xmin + " AS x FROM mon WHERE Acquisition_Type = 'Return From Previous Month'"
        " AND Lifetime_First_Seen_Ts IS NOT NULL AND Order_Month IS NOT NULL)")


def _mtext(m: str) -> str:
    return minute(f"(TIMESTAMP '1970-01-01 00:00:00' + to_minutes(CAST({m} AS BIGINT)))")


def _hist(lo: str, hi: str, bins: int) -> tuple[str, str, str]:
    lo2 = f"(CASE WHEN {lo} = {hi} THEN {lo} - 720 ELSE {lo} END)"
    hi2 = f"(CASE WHEN {lo} = {hi} THEN {hi} + 720 ELSE {hi} END)"
    return f"least((x - {lo2}) * {bins} // ({hi2} - {lo2}), {bins - 1})", lo2, hi2


_b60, _lo60, _hi60 = _hist("(SELECT MIN(x) FROM r)", "(SELECT MAX(x) FROM r)", 60)
_b15, _lo15, _hi15 = _hist("lo", "hi", 15)
_edges_first, _edges_last, _k = "1996-01-07", "1996-12-29", 51

ORACLE_SQL.update({
    "revenue_orders_by_month": f(f"""
SELECT Order_Month,
  COALESCE({isum("CASE WHEN kind = 'new' THEN Total_Customer_Spending END")}, 0) AS New_Spending,
  COALESCE({isum("CASE WHEN kind = 'ret' THEN Total_Customer_Spending END")}, 0) AS Returning_Spending,
  {isum('Num_of_Orders')} AS Num_of_Orders
FROM acqk GROUP BY Order_Month {ACTIVE}"""),
    "brand_share_by_month": f(f"""
SELECT Order_Month, {", ".join(f"COALESCE({fdiv(u, ' + '.join(_u))} * 100.0::DOUBLE, 0.0) AS Units_Pct_{x}"
                               for u, x in zip(_u, SFX))},
  {", ".join(f"COALESCE({fdiv(v, ' + '.join(_s))} * 100.0::DOUBLE, 0.0) AS Spend_Pct_{x}" for v, x in zip(_s, SFX))}
FROM acq GROUP BY Order_Month {ACTIVE}"""),
    "brand_spend_by_month": f(f"""
SELECT Order_Month, {", ".join(f"{v} AS Spend_{x}" for v, x in zip(_s, SFX))}, {" + ".join(_s)} AS Total_Spend
FROM acq GROUP BY Order_Month {ACTIVE}"""),
    "share_by_phase": f(f"""
SELECT CASE WHEN GROUPING(Phase) = 1 THEN 'Toàn kỳ' ELSE Phase END AS Phase,
  COALESCE({isum("CASE WHEN kind = 'new' THEN Num_Of_Customers END")}, 0) AS New_Customers,
  COALESCE({isum("CASE WHEN kind = 'ret' THEN Num_Of_Customers END")}, 0) AS Returning_Customers,
  {fdiv("COALESCE(SUM(CASE WHEN kind = 'new' THEN Num_Of_Customers END), 0)", "COALESCE(SUM(CASE WHEN kind = 'new' THEN Num_Of_Customers END), 0) + COALESCE(SUM(CASE WHEN kind = 'ret' THEN Num_Of_Customers END), 0)")} * 100.0::DOUBLE AS Pct_New,
  {fdiv("COALESCE(SUM(CASE WHEN kind = 'ret' THEN Num_Of_Customers END), 0)", "COALESCE(SUM(CASE WHEN kind = 'new' THEN Num_Of_Customers END), 0) + COALESCE(SUM(CASE WHEN kind = 'ret' THEN Num_Of_Customers END), 0)")} * 100.0::DOUBLE AS Pct_Returning
FROM (SELECT *, {PHASE} AS Phase FROM acqk) a GROUP BY ROLLUP (Phase)"""),
    "aov_basket_by_month": f(f"""
SELECT Order_Month, {of('new', 'Average_Purchase_Value')} AS New_APV, {of('ret', 'Average_Purchase_Value')} AS Returning_APV,
  {of('new', 'Avg_Basket_Size')} AS New_Basket_Size, {of('ret', 'Avg_Basket_Size')} AS Returning_Basket_Size
FROM acqk GROUP BY Order_Month {ACTIVE}"""),
    "cancellation_by_month": f(f"""
SELECT Order_Month, {of('new', 'Cancellation_Rate')} AS New_Cancellation_Rate,
  {of('ret', 'Cancellation_Rate')} AS Returning_Cancellation_Rate
FROM acqk GROUP BY Order_Month {ACTIVE}"""),
    "acquisition_by_month": f(f"""
SELECT Order_Month, {of('new', 'Num_Of_Customers')} AS New_Customers, {PHASE} AS Phase FROM acqk GROUP BY Order_Month"""),
    "new_vs_returning": f(f"""
SELECT Order_Month, {of('new', 'Num_Of_Customers')} AS New_Customers, {of('ret', 'Num_Of_Customers')} AS Returning_Customers
FROM acqk GROUP BY Order_Month"""),
    "spending_asymmetry": f(f"""
SELECT Order_Month, Pct_Num_Of_Customers, Pct_Total_Customer_Spending,
  {fdiv('Pct_Total_Customer_Spending', 'Pct_Num_Of_Customers')} AS Spend_Multiple
FROM acqk WHERE kind = 'ret' AND Pct_Total_Customer_Spending IS NOT NULL"""),
    "apv_frequency_ratio": f(f"""
SELECT Order_Month, APV_Ratio, Frequency_Ratio, Frequency_Ratio > APV_Ratio AS Frequency_Is_Larger_Lever FROM (
  SELECT Order_Month, {fdiv(of('ret', 'Average_Purchase_Value'), of('new', 'Average_Purchase_Value'))} AS APV_Ratio,
    {fdiv(of('ret', 'Buying_Frequency'), of('new', 'Buying_Frequency'))} AS Frequency_Ratio
  FROM acqk GROUP BY Order_Month HAVING {of('ret', 'Average_Purchase_Value')} IS NOT NULL) x"""),
    "basket_mix": f("""
SELECT Order_Month, kind AS Kind, COALESCE(Basket_Pct_Kinka_Products, 0.0) AS Pct_Kinka,
  COALESCE(Basket_Pct_Revy_Products, 0.0) AS Pct_Revy, COALESCE(Basket_Pct_SiMee_Products, 0.0) AS Pct_SiMee,
  100.0::DOUBLE - (((0.0::DOUBLE + COALESCE(Basket_Pct_Kinka_Products, 0.0)) + COALESCE(Basket_Pct_Revy_Products, 0.0))
    + COALESCE(Basket_Pct_SiMee_Products, 0.0)) AS Pct_Other
FROM acqk"""),
    "spend_per_head": f(f"""
SELECT Order_Month, Acquisition_Type, {fdiv('Total_Customer_Spending', 'Num_Of_Customers')} AS Spend_Per_Head FROM acq"""),
    "purchasing_power": f(f"""
SELECT Order_Month, {fdiv('ps_n', 'pc_n')} AS Efficiency_New, {fdiv('ps_r', 'pc_r')} AS Efficiency_Returning,
  {fdiv('apv_r', 'apv_n')} AS APV_Ratio, {fdiv('f_r', 'f_n')} AS Frequency_Ratio,
  CAST(apv_n AS DOUBLE) * f_n AS Power_New, CAST(apv_r AS DOUBLE) * f_r AS Power_Returning,
  {fdiv('CAST(apv_r AS DOUBLE) * f_r', 'CAST(apv_n AS DOUBLE) * f_n')} AS Power_Ratio
FROM (SELECT Order_Month, {of('new', 'Pct_Total_Customer_Spending')} AS ps_n, {of('new', 'Pct_Num_Of_Customers')} AS pc_n,
        {of('ret', 'Pct_Total_Customer_Spending')} AS ps_r, {of('ret', 'Pct_Num_Of_Customers')} AS pc_r,
        {of('new', 'Average_Purchase_Value')} AS apv_n, {of('ret', 'Average_Purchase_Value')} AS apv_r,
        {of('new', 'Buying_Frequency')} AS f_n, {of('ret', 'Buying_Frequency')} AS f_r
      FROM acqk WHERE Order_Month >= '1996-01' GROUP BY Order_Month
      HAVING COUNT(CASE WHEN kind = 'new' THEN 1 END) > 0 AND COUNT(CASE WHEN kind = 'ret' THEN 1 END) > 0) p"""),
    # funnel feeds
    "funnel_ltv_rank": f(f"""
SELECT Funnel_Group, {_n} AS Num_Of_Customers, {_ltv} AS Avg_Customer_Value, {_n} * {_ltv} AS Total_Value,
  ROW_NUMBER() OVER (ORDER BY {_ltv}, Funnel_Group) AS Ltv_Rank FROM fg"""),
    "switcher_weight": f(f"""
SELECT *, {fdiv('Switcher_Customers', 'Switcher_Customers + Other_Customers')} * 100.0::DOUBLE AS Switcher_Pct_Customers,
  {fdiv('Switcher_Value', 'Switcher_Value + Other_Value')} * 100.0::DOUBLE AS Switcher_Pct_Value,
  {fdiv(fdiv('Switcher_Value', 'Switcher_Customers'), fdiv('Other_Value', 'Other_Customers'))} AS Value_Per_Head_Ratio
FROM (SELECT {isum(f"CASE WHEN {_sw} THEN {_n} ELSE 0 END")} AS Switcher_Customers,
        {isum(f"CASE WHEN NOT ({_sw}) THEN {_n} ELSE 0 END")} AS Other_Customers,
        SUM(CASE WHEN {_sw} THEN {_n} * {_ltv} ELSE 0.0 END) AS Switcher_Value,
        SUM(CASE WHEN NOT ({_sw}) THEN {_n} * {_ltv} ELSE 0.0 END) AS Other_Value FROM fg) t"""),
    "cross_buy_rate": f("SELECT *, CASE WHEN Only_Customers + Start_Customers <> 0 THEN "
                        + fdiv("Start_Customers", "Only_Customers + Start_Customers")
                        + " * 100.0::DOUBLE ELSE 0.0 END AS Cross_Buy_Rate FROM (\n" + "\nUNION ALL\n".join(
                            f"SELECT '{b}' AS Brand, COALESCE({isum(f'CASE WHEN Funnel_Group = {chr(39)}Only with {b}{chr(39)} THEN {_n} END')}, 0) AS Only_Customers, "
                            f"COALESCE({isum(f'CASE WHEN Funnel_Group = {chr(39)}Start with {b}{chr(39)} THEN {_n} END')}, 0) AS Start_Customers FROM fg"
                            for b in ("Kinka", "Revy", "SiMee")) + ") x"),
    "days_to_switch_rank": f("""
SELECT Funnel_Group, Avg_Days_To_Switch, ROW_NUMBER() OVER (ORDER BY Avg_Days_To_Switch, Funnel_Group) AS Switch_Rank
FROM fg WHERE Avg_Days_To_Switch IS NOT NULL"""),
    "funnel_cancel_rate": f("""
SELECT Funnel_Group, Cancel_Rate, ROW_NUMBER() OVER (ORDER BY Cancel_Rate, Funnel_Group) AS Cancel_Rank FROM (
  SELECT Funnel_Group, CASE WHEN COALESCE(Avg_Num_Of_Orders, 0.0) <> 0
    THEN (COALESCE(Avg_Num_of_Canceled_Orders, 0.0) / COALESCE(Avg_Num_Of_Orders, 0.0)) * 100.0::DOUBLE ELSE 0.0 END
    AS Cancel_Rate FROM fg) x"""),
    "value_map": f(f"""
SELECT Funnel_Group, {_n} AS Num_Of_Customers, {_ltv} AS Avg_Customer_Value,
  COALESCE(Avg_Num_Of_Orders, 0.0) AS Avg_Num_Of_Orders,
  {fdiv(f'SUM({_n} * {_ltv}) OVER ()', f'SUM({_n}) OVER ()')} AS Weighted_Avg_Customer_Value FROM fg"""),
    "monthly_funnel_stack": f("SELECT *, " + " + ".join(f'"{g}"' for g in (*_stack, "Other")) + " AS Total FROM (SELECT Month, "
                              + f"""COALESCE({isum(f"CASE WHEN Funnel_Group NOT IN ({', '.join(chr(39) + g + chr(39) for g in _stack)}) OR Funnel_Group IS NULL THEN Num_of_Customers END")}, 0) AS "Other", """
                              + ", ".join(f"""COALESCE({isum(f"CASE WHEN Funnel_Group = '{g}' THEN Num_of_Customers END")}, 0) AS "{g}\""""
                                          for g in _stack) + " FROM mfg GROUP BY Month) x"),
    "switcher_share_by_month": f(f"""
SELECT Month, Cohort_Size, CASE WHEN Cohort_Size <> 0 THEN {fdiv('sw', 'Cohort_Size')} * 100.0::DOUBLE ELSE 0.0 END
  AS Switcher_Share, DENSE_RANK() OVER (ORDER BY Month DESC) <= 2 AS Censored
FROM (SELECT Month, {isum('Num_of_Customers')} AS Cohort_Size,
        {isum("CASE WHEN Funnel_Group LIKE 'Start%' THEN Num_of_Customers ELSE 0 END")} AS sw
      FROM mfg GROUP BY Month) x"""),
    # histograms
    "first_seen_hist": f(f""", r AS {_ret}
SELECT Order_Month, {_b60} AS Bin, COUNT(*) AS Num_Customers, {_mtext(_lo60)} AS Range_Start, {_mtext(_hi60)} AS Range_End
FROM r GROUP BY 1, 2""".replace("\n, r AS", ", r AS", 1)),
    "first_seen_hist_by_month": f(f""", r AS {_ret}
SELECT Order_Month, {_b15} AS Bin, {_mtext(_lo15)} AS Range_Start, {_mtext(_hi15)} AS Range_End, COUNT(*) AS Num_Customers
FROM (SELECT r.*, g.lo, g.hi FROM r JOIN (SELECT Order_Month, MIN(x) AS lo, MAX(x) AS hi FROM r GROUP BY 1) g
      USING (Order_Month)) j GROUP BY 1, 2, 3, 4"""),
    # per-SKU series
    "sku_weekly_price": f(f""", w AS (
  SELECT Product_SKU_Name, Product_Variant, {wk('Created_At', 'MON')} AS Week,
    AVG(SKU_Unit_Original_Price) AS Avg_Original_Price, AVG({_after_seller}) AS Avg_After_Seller_Discount,
    AVG(CASE WHEN Quantity <> 0 THEN CAST(Order_Amount AS DOUBLE) / CAST(Quantity AS DOUBLE) END) AS Avg_Customer_Paid
  FROM lines WHERE Created_At IS NOT NULL AND Created_At <= TIMESTAMP '2000-12-31 23:59:59'
    AND SKU_Unit_Original_Price > 0 AND Product_SKU_Name IS NOT NULL AND Product_Variant IS NOT NULL
  GROUP BY 1, 2, 3),
weeks AS (SELECT Product_SKU_Name, Product_Variant,
    CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS Week
  FROM (SELECT Product_SKU_Name, Product_Variant, MIN(Week) AS a, MAX(Week) AS b FROM w GROUP BY 1, 2) s)
SELECT weeks.Product_SKU_Name, weeks.Product_Variant, weeks.Week, w.Avg_Original_Price, w.Avg_After_Seller_Discount,
  w.Avg_Customer_Paid
FROM weeks LEFT JOIN w ON weeks.Product_SKU_Name = w.Product_SKU_Name AND weeks.Product_Variant = w.Product_Variant
  AND weeks.Week = w.Week""".replace("\n, w AS", ", w AS", 1)),
    "sku_weekly_units": f("SELECT * FROM (SELECT " + wk("Created_At", "MON") + " AS Week, " + ", ".join(
        f"""COALESCE({isum(f"CASE WHEN Product_SKU_Name = '{n}' THEN Quantity END")}, 0) AS "{n}\"""" for n in NAMES)
        + f" FROM lines WHERE Created_At IS NOT NULL AND Created_At <= TIMESTAMP '2000-12-31 23:59:59' AND {IN_SKUS}"
        " GROUP BY 1) x WHERE " + " + ".join(f'"{n}"' for n in NAMES) + " > 0"),
    "sku_weekly_line_counts": f(f"""
SELECT Product_SKU_Name, Product_Variant, Bin, COUNT(*) AS Num_Lines,
  CAST(DATE '{_edges_first}' + CAST(Bin * 7 AS INTEGER) AS DATE) AS Bin_Start
FROM (SELECT *, least(date_diff('second', TIMESTAMP '{_edges_first} 00:00:00', Created_At) // 604800, {_k - 1}) AS Bin
      FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS}
        AND Created_At >= TIMESTAMP '{_edges_first} 00:00:00' AND Created_At <= TIMESTAMP '{_edges_last} 00:00:00') x
GROUP BY 1, 2, 3"""),
    "sku_weekly_quantity": f("SELECT " + wk("Created_At", "SUN") + " AS Period, " + ", ".join(
        f"""COALESCE({isum(f"CASE WHEN Product_SKU_Name = '{n}' THEN Quantity END")}, 0) AS "{n}\"""" for n in NAMES)
        + f" FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS} GROUP BY 1"),
    "sku_daily_quantity": f("SELECT CAST(Created_At AS DATE) AS Period, " + ", ".join(
        f"""COALESCE({isum(f"CASE WHEN Product_SKU_Name = '{n}' THEN Quantity END")}, 0) AS "{n}\"""" for n in NAMES)
        + f" FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS} GROUP BY 1"),
    "sku_weekly_mean_subtotal": f("SELECT " + wk("Created_At", "SUN") + " AS Week, " + ", ".join(
        f"""AVG(CASE WHEN Product_SKU_Name = '{n}' THEN SKU_Subtotal_After_Discount END) AS "{n}\"""" for n in NAMES)
        + f" FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS} GROUP BY 1"),
    "sku_weekly_mean_price": f("SELECT " + wk("Created_At", "SUN") + " AS Week, " + ", ".join(
        f"""AVG(CASE WHEN Product_SKU_Name = '{n}' THEN SKU_Unit_Original_Price END) AS "{n}\"""" for n in NAMES)
        + f" FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS} GROUP BY 1"),
    "sku_weekly_mean_after_seller": f("SELECT " + wk("Created_At", "SUN") + " AS Week, " + ", ".join(
        f"""AVG(CASE WHEN Product_SKU_Name = '{n}' THEN greatest({_after_seller}, 0.0) END) AS "{n}\"""" for n in NAMES)
        + f" FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS} GROUP BY 1"),
    "sku_daily_price_range": f(f"""
SELECT CAST(Created_At AS DATE) AS Day, Product_SKU_Name, MIN(SKU_Subtotal_After_Discount) AS Min_Subtotal,
  MAX(SKU_Subtotal_After_Discount) AS Max_Subtotal, AVG(SKU_Subtotal_After_Discount) AS Mean_Subtotal
FROM lines WHERE Created_At IS NOT NULL AND {IN_SKUS} GROUP BY 1, 2 HAVING AVG(SKU_Subtotal_After_Discount) IS NOT NULL"""),
})

_TYPED = ", ".join(f"CASE WHEN CAST(SKU_ID AS BIGINT) % 11 = 0 THEN NULL ELSE Quantity END AS Quantity" if c == "Quantity" else c
                   for c in ("Order_ID", "SKU_ID", "Order_Status", "Normal_Or_Pre_order", "Created_At", "Buyer_Username",
                             "Quantity", "Order_Amount", "SKU_Unit_Original_Price", "SKU_Subtotal_Before_Discount",
                             "SKU_Seller_Discount", "SKU_Subtotal_After_Discount"))
ORACLE_SQL["cast_order_lines"] = f"WITH {ADAPTER}\nSELECT {_TYPED} FROM order_lines"
ORACLE_SQL["export_rejects"] = f"""WITH {ADAPTER}
SELECT 'Quantity' AS "Column", COUNT(*) AS Num_Rejected FROM order_lines WHERE CAST(SKU_ID AS BIGINT) % 11 = 0
UNION ALL SELECT unnest(['Created_Time', 'Order_Amount', 'SKU_Unit_Original_Price', 'SKU_Subtotal_Before_Discount',
  'SKU_Seller_Discount', 'SKU_Subtotal_After_Discount']), 0"""
ORACLE_SQL["dedupe_labels"] = f"WITH {ADAPTER}\nSELECT * FROM product_labels"
_COUNTED = ("label_order_lines", "missing_label_ids", "total_orders_data", "total_customers_data",
            "pivot_loyalty_tier", "monthly_customers_data", "pivot_monthly_customers_acquisition",
            "pivot_monthly_products", "monthly_retention_rate")
ORACLE_SQL["row_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS Dataset, COUNT(*) AS Num_Rows FROM ({ORACLE_SQL[n]}) t" for n in _COUNTED)
ORACLE_SQL["active_months"] = f("""
SELECT Order_Month, CAST(SUM(Total_Customer_Spending) AS BIGINT) AS Total_Customer_Spending FROM acq
GROUP BY Order_Month HAVING SUM(Total_Customer_Spending) > 0""")
ORACLE_SQL["export_files_by_name"] = ORACLE_SQL["cast_order_lines"]
ORACLE_SQL["export_quarantine"] = f"""WITH {ADAPTER}
SELECT Order_ID, 'Quantity' AS "Column", 'n/a' AS "Text" FROM order_lines WHERE CAST(SKU_ID AS BIGINT) % 11 = 0"""
ORACLE_SQL["ingest_balance"] = f"""WITH {ADAPTER},
n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (CAST(SKU_ID AS BIGINT) % 11 = 0) AS bad FROM order_lines)
SELECT 'raw' AS Dataset, n + 1 AS Num_Rows FROM n UNION ALL SELECT 'lines', n - bad FROM n
UNION ALL SELECT 'quarantine', bad FROM n UNION ALL SELECT 'descriptions', 1"""
ORACLE_SQL["orders_read_back"] = f"SELECT *, substr(Order_Time, 1, 7) AS Order_Month FROM ({ORACLE_SQL['total_orders_data']}) t"
ORACLE_SQL["labelled_csv_read_back"] = ORACLE_SQL["label_order_lines"]
ORACLE_SQL["exported_row_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS Dataset, COUNT(*) AS Num_Rows FROM ({ORACLE_SQL[n]}) t"
    for n in ("total_customers_data", "pivot_loyalty_tier", "monthly_customers_data", "switch_total_funnel_group"))
