"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times for the record; the median counts. The result is
written to Spark's ``noop`` sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "kpi_cards", "kpi_daily",
    "metric_average_ticket_value",
    "metric_staff_attachment_rate", "metric_wide_by_staff", "trend_revenue_traffic_weekly",
    "tree_revenue", "drill_by_date_and_invoice",
    "inventory_list", "stock_by_product_and_serial", "serials_in_stock", "ledger_batch_judged",
    "checkout_verdicts", "cart_consolidated", "payment_reconciliation", "invoice_documents",
    "sales_lines", "invoice_list", "sales_validated", "sales_completeness",
    "product_batch_report", "upload_products_consolidated", "integrity_audit",
    "sheet_typed", "metric_devices_per_transaction", "metric_conversion_rate_daily",
    "period_last_months_head_tail", "filter_choices", "trend_promo_invoice_monthly",
    "upload_violations", "sales_payment_lists", "sheet_cleaned_from_csv", "checkout_items",
    "ledger_batch_outcome", "upload_summary", "upload_applied_in_order",
    "stream_stock_balance", "stream_ledger_booked", "ledger_batch_judged_in_order",
]


def main() -> None:
    from shoptally.plans import all_queries
    from shoptally.session import build

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build(
        "shoptally-bench", f"local[{cpus}]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = all_queries(), {}
    for name in HEADLINE:
        laps = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - began)
        took[name] = round(statistics.median(laps[1:]), 3)
        print(f"{name:34s} {took[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": float(sf.group(1)) if sf else None,
        "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
