"""Named datasets over a :class:`LoyaltyData` — the ``queries()`` surface."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalframe.config import LoyaltyConfig
from loyalframe.operators import adhoc, customers, monthly, orders, products, retention, segments, switching
from loyalframe.operators import feeds_acquisition as fa
from loyalframe.operators import feeds_funnel as ff
from loyalframe.operators import feeds_hist as fh
from loyalframe.operators import feeds_sku as fs
from loyalframe.operators.labelling import dedupe_labels, missing_label_ids
from loyalframe.operators.orders import orders_frame
from loyalframe.plans import round_trips as rt
from loyalframe.plans.pipeline import LoyaltyData, present_lines, written
from loyalframe.sources.adapter import export_text_from_tables, label_rows_from_tables
from loyalframe.sources.ingest import cast_order_lines, rejects
from loyalframe.sources.sinks import MONTH, row_counts

# parameters of the ad-hoc questions when run over the benchmark tables
ACTIVE_FROM, ACTIVE_TO = "1996-04-01", "1996-05-01"
SUBCATEGORY, SUBCATEGORY_MONTH = "MEDIUM/0", "1996-03"
# chart parameters over the benchmark tables' calendar (1995-2001): the
# phase ends, report end, SKU targets, fixed histogram window, first month
PHASE_CONFIG = LoyaltyConfig(phases=(("P1", "1996-12"), ("P2", "1999-06"), ("P3", None)))
SCOPE_END = "2000-12-31 23:59:59"
SKU_TARGETS = [("blue rod", "Brand#25"), ("hot gear", "Brand#25"), ("cold bolt", "Brand#5")]
HIST_FROM, HIST_TO = "1996-01-01", "1996-12-31"
POWER_FROM = "1996-01"


def _acq(d):
    return segments.pivot_monthly_customers_acquisition(d.monthly, d.cfg)


def _fg(d):
    return switching.switch_total_funnel_group(d.buyers)


def _mfg(d):
    return switching.switch_monthly_funnel_group(d.buyers)


DATASETS: dict[str, Callable[[LoyaltyData], DataFrame]] = {
    # ingest / joins
    "label_order_lines": lambda d: present_lines(d.lines).drop(MONTH),
    "missing_label_ids": lambda d: missing_label_ids(d.raw_lines, d.labels),
    # main datasets
    "total_orders_data": lambda d: orders.total_orders_data(d.orders, d.cfg),
    "total_customers_data": lambda d: customers.total_customers_data(d.customers, d.cfg),
    "filter_loyal_switching_customers": lambda d: customers.filter_loyal_switching_customers(d.customers),
    "pivot_loyalty_tier": lambda d: segments.pivot_loyalty_tier(d.buyers, d.cfg),
    "monthly_customers_data": lambda d: monthly.monthly_customers_data(d.monthly, d.cfg),
    "pivot_monthly_customers_acquisition": lambda d: segments.pivot_monthly_customers_acquisition(d.monthly, d.cfg),
    "pivot_monthly_products": lambda d: products.pivot_monthly_products(d.lines, d.cfg),
    "switch_total_switching_status": lambda d: switching.switch_total_switching_status(d.buyers),
    "switch_monthly_switching_status_loyal": lambda d: switching.switch_monthly_switching_status_loyal(d.buyers),
    "switch_total_funnel_group": lambda d: switching.switch_total_funnel_group(d.buyers),
    "switch_total_funnel_group_by_status": lambda d: switching.switch_total_funnel_group_by_status(d.buyers),
    "switch_monthly_funnel_group": lambda d: switching.switch_monthly_funnel_group(d.buyers),
    "switch_monthly_funnel_group_switcher": lambda d: switching.switch_monthly_funnel_group_switcher(d.buyers),
    "monthly_sku_sales": lambda d: products.monthly_sku_sales(d.lines, d.cfg),
    "loyal_status_share": lambda d: switching.loyal_status_share(d.buyers),
    "entry_month_by_tier": lambda d: adhoc.entry_month_by_tier(d.buyers),
    "returning_customers": lambda d: monthly.monthly_customers_data(monthly.returning_customers(d.monthly), d.cfg),
    # windows
    "monthly_retention_rate": lambda d: retention.monthly_retention_rate(d.monthly),
    "pool_vs_retention": lambda d: retention.pool_vs_retention(d.monthly),
    "second_purchase": lambda d: d.by_buyer(adhoc.second_purchase),
    # ad-hoc
    "customers_active_between": lambda d: d.by_buyer(
        lambda orders: adhoc.customers_active_between(orders, ACTIVE_FROM, ACTIVE_TO, d.cfg)),
    "monthly_funnel": lambda d: adhoc.monthly_funnel(d.orders, d.cfg),
    "subcategory_month_lines": lambda d: present_lines(
        adhoc.subcategory_month_lines(d.lines, SUBCATEGORY, SUBCATEGORY_MONTH)).drop("Month_Year", MONTH),
    # chart feeds over the monthly acquisition summary
    "revenue_orders_by_month": lambda d: fa.revenue_orders_by_month(_acq(d)),
    "brand_share_by_month": lambda d: fa.brand_share_by_month(_acq(d), d.cfg),
    "brand_spend_by_month": lambda d: fa.brand_spend_by_month(_acq(d), d.cfg),
    "share_by_phase": lambda d: fa.share_by_phase(_acq(d), PHASE_CONFIG),
    "aov_basket_by_month": lambda d: fa.aov_basket_by_month(_acq(d)),
    "cancellation_by_month": lambda d: fa.cancellation_by_month(_acq(d)),
    "acquisition_by_month": lambda d: fa.acquisition_by_month(_acq(d), PHASE_CONFIG),
    "new_vs_returning": lambda d: fa.new_vs_returning(_acq(d)),
    "spending_asymmetry": lambda d: fa.spending_asymmetry(_acq(d)),
    "apv_frequency_ratio": lambda d: fa.apv_frequency_ratio(_acq(d)),
    "basket_mix": lambda d: fa.basket_mix(_acq(d), d.cfg),
    "spend_per_head": lambda d: fa.spend_per_head(_acq(d)),
    "purchasing_power": lambda d: fa.purchasing_power(_acq(d), POWER_FROM),
    # chart feeds over the funnel tables
    "funnel_ltv_rank": lambda d: ff.funnel_ltv_rank(_fg(d)),
    "switcher_weight": lambda d: ff.switcher_weight(_fg(d)),
    "cross_buy_rate": lambda d: ff.cross_buy_rate(_fg(d), d.cfg),
    "days_to_switch_rank": lambda d: ff.days_to_switch_rank(_fg(d)),
    "funnel_cancel_rate": lambda d: ff.funnel_cancel_rate(_fg(d)),
    "value_map": lambda d: ff.value_map(_fg(d)),
    "monthly_funnel_stack": lambda d: ff.monthly_funnel_stack(_mfg(d)),
    "switcher_share_by_month": lambda d: ff.switcher_share_by_month(_mfg(d)),
    # histograms
    "first_seen_hist": lambda d: fh.first_seen_hist(d.monthly),
    "first_seen_hist_by_month": lambda d: fh.first_seen_hist_by_month(d.monthly),
    # per-SKU series
    "sku_weekly_price": lambda d: fs.sku_weekly_price(d.lines, SCOPE_END),
    "sku_weekly_units": lambda d: fs.sku_weekly_units(d.lines, SKU_TARGETS, SCOPE_END),
    "sku_weekly_line_counts": lambda d: fs.sku_weekly_line_counts(d.lines, SKU_TARGETS, HIST_FROM, HIST_TO),
    "sku_weekly_quantity": lambda d: fs.sku_quantity(d.lines, SKU_TARGETS, "W"),
    "sku_daily_quantity": lambda d: fs.sku_quantity(d.lines, SKU_TARGETS, "D"),
    "sku_weekly_mean_subtotal": lambda d: fs.sku_weekly_mean(d.lines, SKU_TARGETS, "subtotal"),
    "sku_weekly_mean_price": lambda d: fs.sku_weekly_mean(d.lines, SKU_TARGETS, "original_price"),
    "sku_weekly_mean_after_seller": lambda d: fs.sku_weekly_mean(d.lines, SKU_TARGETS, "after_seller"),
    "sku_daily_price_range": lambda d: fs.sku_daily_price_range(d.lines, SKU_TARGETS),
}

# The row counts the shop's pipeline reports after each step
COUNTED = ("label_order_lines", "missing_label_ids", "total_orders_data", "total_customers_data",
           "pivot_loyalty_tier", "monthly_customers_data", "pivot_monthly_customers_acquisition",
           "pivot_monthly_products", "monthly_retention_rate")


def _row_counts(d: LoyaltyData):
    # the order table is written once, with each order's number of lines and
    # of unlabelled lines: eight of the nine counts come from it. Counts
    # carried in rows are exact however often a task is run again, unlike
    # counters kept beside a job. Only the product table reads the lines again.
    orders_n = written(orders_frame(d.flagged_lines("Has_Label"), d.cfg, counts=True), "counted_orders")
    fixed = LoyaltyData(d.raw_lines, d.labels, d.cfg)
    fixed.__dict__.update(lines=d.lines, orders=orders_n.drop("Num_Lines", "Num_Unlabelled_Lines"))
    summed = orders_n.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("Num_Lines", "Num_Unlabelled_Lines")])
    summed = summed.select(F.inline(F.array(
        F.struct(F.lit("label_order_lines").alias("Dataset"), F.col("Num_Lines").alias("Num_Rows")),
        F.struct(F.lit("missing_label_ids").alias("Dataset"), F.col("Num_Unlabelled_Lines").alias("Num_Rows")))))
    return summed.unionByName(row_counts({n: DATASETS[n](fixed) for n in COUNTED[2:]}))


def _cast_order_lines(d: LoyaltyData):
    return cast_order_lines(export_text_from_tables(*d.tables)).drop("Created_Time")


def _export_rejects(d: LoyaltyData):
    return rejects(export_text_from_tables(*d.tables))


# S2 / S4 over a text rendering of the tables
DATASETS["cast_order_lines"] = _cast_order_lines
DATASETS["export_rejects"] = _export_rejects
DATASETS["dedupe_labels"] = lambda d: dedupe_labels(label_rows_from_tables(*d.tables))
DATASETS["row_counts"] = _row_counts
# S1, S3-S9 through files in the shared folder
DATASETS["export_files_by_name"] = rt.export_files_by_name
DATASETS["export_quarantine"] = rt.export_quarantine
DATASETS["ingest_balance"] = rt.ingest_balance
DATASETS["orders_read_back"] = rt.orders_read_back
DATASETS["labelled_csv_read_back"] = rt.labelled_csv_read_back
EXPORTED = ("total_customers_data", "pivot_loyalty_tier", "monthly_customers_data", "switch_total_funnel_group")
DATASETS["exported_row_counts"] = lambda d: rt.exported_row_counts(d, {n: DATASETS[n] for n in EXPORTED})
DATASETS["active_months"] = lambda d: fa.active_months(_acq(d))
