"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is run to completion into a sink that
discards the rows, so all columns are computed and nothing travels to the driver. One query runs first to warm up and does
not count; then there are up to three rounds, as many as fit into the time, and the median of a query's runs is given.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from stockloom.plans import catalog
from stockloom.session import build_session

ROUNDS, ENOUGH_SECONDS = 3, 240

HEADLINE = (
    "v11_live_inventory", "v12_history", "v13_legacy_live", "v14_running_stock", "v7_latest_event",
    "q2_live_summary", "q3_history_query", "d1_dashboard", "d6_rental_board", "d12_margin_band",
    "i4_upsert_items", "i7_close_rentals", "i10_action_result", "m5_backfill_rentals", "m7_migration_counts",
    "r4_role_view", "r6_audit_items", "a1_baseline_check", "a2_unpaired_rentals", "a5_duplicate_submits",
    "a8_count_delta", "a11_discrepancy_trend", "a17_assign_cause",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry = catalog.registry()
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()

    def run(name: str) -> float:
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("v11_live_inventory")
    began, runs = time.perf_counter(), {name: [] for name in HEADLINE}
    for k in range(ROUNDS):
        for name in HEADLINE:
            if not k or time.perf_counter() - began < ENOUGH_SECONDS:
                runs[name].append(run(name))
    times = {name: round(statistics.median(seconds), 3) for name, seconds in runs.items()}
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "spark": spark.version, "cores": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
