"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three runs each, and the first of them (cold); prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from logloom.plans import catalogue
from logloom.session import local_session

HEADLINE = (
    "log_search_filters", "log_search_substring", "log_search_page", "log_histogram_1h", "log_histogram_pivot", "top_services", "dashboard_kpis", "dashboard_timeseries", "rollup_hourly", "top_orgs",
    "trace_rollup", "trace_stats", "service_dependencies", "span_waterfall", "alert_fire", "alert_preview_incidents", "sigma_match_web", "siem_top_threats", "incident_by_trace", "identifiers_extract", "error_groups",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("log_histogram_1h")  # starts the session's machinery
    took, cold = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            run(name)
            runs.append(time.time() - began)
        took[name], cold[name] = round(sorted(runs)[1], 3), round(runs[0], 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
