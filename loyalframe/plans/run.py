"""The whole pipeline in one run: ingest -> every dataset -> counts.

``python -m loyalframe.plans.run --lines export.csv --labels labels.csv --out DIR``

The shared intermediates (labelled lines, orders) are checkpointed to
``spark.checkpoint.dir`` once, so each dataset write starts from them and
a lost executor never sends the job back to the raw export.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from loyalframe.config import DEFAULT_CONFIG
from loyalframe.plans.pipeline import LoyaltyData
from loyalframe.plans.registry import COUNTED, DATASETS
from loyalframe.session import apply_session_conf
from loyalframe.sources.ingest import read_labels, read_order_lines
from loyalframe.sources.sinks import export_all, read_dataset, row_counts

# the datasets the shop's pipeline stored, plus the loyal-switcher filter
PIPELINE_DATASETS = (
    "label_order_lines", "total_orders_data", "total_customers_data", "filter_loyal_switching_customers",
    "pivot_loyalty_tier", "monthly_customers_data", "pivot_monthly_customers_acquisition",
    "switch_total_switching_status", "switch_monthly_switching_status_loyal", "switch_total_funnel_group",
    "switch_monthly_funnel_group", "switch_monthly_funnel_group_switcher", "pivot_monthly_products",
    "monthly_retention_rate",
)


def run_pipeline(data: LoyaltyData, out_dir: str, fmt: str = "parquet",
                 names: tuple = PIPELINE_DATASETS) -> DataFrame:
    """Write ``names`` under ``out_dir`` and return their row counts."""
    data.checkpoint(lines=True).write_cube()
    built = {n: DATASETS[n](data) for n in names}
    paths = dict(zip(names, export_all({n: (lambda n=n: built[n]) for n in names}, out_dir, fmt)))
    # what was written is counted from the files, the rest from its plan
    readable = fmt in ("parquet", "csv", "orc", "json")
    spark = data.lines.sparkSession
    return row_counts({
        n: read_dataset(spark, paths[n], fmt, built[n].schema) if readable and n in paths else DATASETS[n](data)
        for n in COUNTED})


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--lines", required=True)
    ap.add_argument("--labels", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--lines-format", default="csv")
    ap.add_argument("--format", default="parquet")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("loyalframe-pipeline").getOrCreate()
    apply_session_conf(spark)
    t0 = time.time()
    data = LoyaltyData(read_order_lines(spark, a.lines, a.lines_format), read_labels(spark, a.labels),
                       DEFAULT_CONFIG)
    run_pipeline(data, a.out, a.format).show(truncate=False)
    print(f"pipeline done in {time.time() - t0:.1f}s")


if __name__ == "__main__":
    main()
