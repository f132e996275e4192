"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds, the median of three runs each."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from lakewarden import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["top_branches_by_accounts", "top_products_5way", "account_stats_6m_1y_now", "account_stats_180_365_latest", "agg_risk_by_dims", "trial_balance", "general_ledger_running", "aged_buckets", "cash_flow_month", "txn_screening_rules", "risk_scores", "risk_composite", "screen_name_or", "cdc_classify", "merge_upsert", "validate_stage_status", "interval_days_month", "events_session", "kw_scan_boundary", "except_rows"]

#: Measured beside the headline queries, and not in their sum.
MORE = ["drill_downs", "sql_rules_many", "ledger_six_way", "staged_coercion", "introducer_rollup", "snippet_rule_hits", "leave_days_department", "import_stage", "surrogate_row_number"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in ("top_branches_by_accounts", "risk_scores"):  # code is compiled once, outside the figures
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 3)
    more = {}
    for name in MORE:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        more[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf"), "more": more}))


if __name__ == "__main__":
    main()
