"""Bench: seconds per headline query, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
local threads. Every query is run to its full result with a noop sink after one warm-up of
the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stepline.plans import catalog  # noqa: E402
from stepline.session import clear_scratch, local_session  # noqa: E402

HEADLINE = [
    "job_bench_report",
    "accuracy_by_kind",
    "step_success",
    "ece_edges",
    "ece_floor",
    "brier",
    "latency_percentiles",
    "threshold_curve",
    "temperature_nll",
    "prediction_drift",
    "running_success",
    "job_episode_filter",
    "episode_stats",
    "drop_repeated_states",
    "decision_sequence",
    "hash_mod_split",
    "keyed_shuffle",
    "stratified_round_robin",
    "length_bucket_batches",
    "train_variants",
    "recent_actions",
    "norm_ws",
    "luhn",
    "pii_find",
    "job_pii_scan",
    "redact_row",
    "decontaminate",
    "leak_split",
    "flatten_step",
    "content_digest",
    "read_trace_tables",
    "page_nodes",
    "job_convert_pages",
    "job_build_dataset",
    "stream_drop_repeats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        clear_scratch(spark)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
