"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics as stats
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import ALL  # noqa: E402
from tablewright.session import local_session  # noqa: E402

HEADLINE = (
    "revenue_by_status", "missing_profile", "column_profile", "numeric_summary", "kpis",
    "correlations", "anomalies", "category_summary", "quality_score", "chart_pie",
    "chart_histogram", "trend_rollup", "monthly_totals", "yoy_mom", "trend_fit", "forecast",
    "segment_benchmark", "volume_vs_value", "kpi_strip", "null_sweep", "currency_strip",
    "parse_dates", "clean_text", "dedup_gated", "dedup_full", "iqr_cap", "scorecard",
    "fuzzy_merge", "near_duplicate_pairs", "chunk_documents", "similar_topk", "ffill_bfill",
    "clean_orders",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        build = ALL[name][0]
        times = []
        for _ in range(repeats + 1):  # the first run warms up
            started = time.perf_counter()
            build(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(stats.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries, median after one warm-up",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
