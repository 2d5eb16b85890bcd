"""Times the headline queries: one run to warm up, then the faster of two.

Prints one JSON line. BENCH_SF_DIR names the data folder, BENCH_CPUS the local threads.
"""

import json
import os
import time

from sensorloom.plans.catalogue import JOBS
from sensorloom.session import build_session

QUERIES = [
    "sample_by_hour", "sampled_tail_by_minute", "window_functions", "window_avg_of_suppliers", "evaluate_windowed_formula",
    "evaluate_conditions", "evaluate_on_demand_sampled", "evaluate_sampled_fleet", "apply_current_rules", "apply_changing_rules",
    "evaluate_composite_formula", "evaluate_chain_over_a_day", "simulation_metrics_of_composite", "decoded_messages",
    "resolved_serials", "latest_points", "buffer_read", "formula_references", "formula_levels", "created_sensors",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(",")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in wanted:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            JOBS[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
