"""Headline queries on one machine; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Each query is run once to warm up and then timed; the result is written to a sink that keeps
nothing, so that every output column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import registry  # noqa: E402
from flowcast.session import build_session  # noqa: E402

HEADLINE = (
    "normalize_flows", "flow_windows", "sliding_windows", "entropy_features", "window_features", "labeled_windows",
    "horizon_labels", "label_interval_join", "history_sequences", "rule_forecast", "rule_explanations", "forecast_policy",
    "lead_times", "roc_auc", "calibrate_threshold", "alerts", "triage_status", "ema_oscillator",
)
FLOW_RATES = ("normalize_flows", "window_features", "horizon_labels", "lead_times")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    flows = spark.read.parquet(f"{folder}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        query = registry.QUERIES[name]
        for timed in (False, True):
            started = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - started, 3)
    rates = {name: round(flows / times[name]) for name in FLOW_RATES}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "flows": flows, "flows_per_sec": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
