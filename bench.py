"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from forewarn.catalog import QUERIES
from forewarn.session import local

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "f18_all_features", "r18_batch_scoring", "c8_interventions", "a1_band_distribution", "a7_kpis", "a9_crosstab",
    "w1_band_top_list", "p18_keep_last", "j4_point_in_time", "h4_deposits_before_due", "n2_account_rollup", "t6_alerts",
    "t2_stream_totals", "t8_rolling_healthcare", "m11_roc_auc", "m12_precision_recall", "w8_stratified_split",
]


def main():
    spark = local(CPUS, int(CPUS) if CPUS.isdigit() else 8, "forewarn-bench")
    # code is compiled on the smallest tables first, so that the times are those of the work
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(small) else []:
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times, plans = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        df = QUERIES[name](spark, SF_DIR)
        df._jdf.queryExecution().executedPlan()
        plans[name] = round(time.perf_counter() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "plan_seconds": plans,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows_per_sec": {n: round(rows / times[n]) for n in ("f18_all_features", "r18_batch_scoring", "c8_interventions")}}))


if __name__ == "__main__":
    main()
