"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; its figure is the median of those.
The whole result is produced and dropped (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gridloom.queries import QUERIES
from gridloom.session import build_session

HEADLINE = (
    "rocof_summary", "rocof", "asof_nearest", "asof_backward", "asof_by_site", "fusion_chain", "breach_windows",
    "excursions", "rocof_clusters", "rolling_stats", "rolling_quantile", "lag_features", "fill_chain", "resample",
    "bucket_targets", "time_in_band", "inertia_trend", "volatility", "yearly_totals", "overview_rollup", "describe_ratio",
    "width_bins", "quantile_bins", "corr_rank", "dedupe_keep_last", "row_stride", "even_downsample", "running_total",
    "inertia_estimate", "replay_metrics", "ingest_signal_csv", "infer_types", "sink_year_week", "append_dedupe",
    "validate_contract", "freshness",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.log.level": "ERROR"},
    )
    timings: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:] or taken), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
