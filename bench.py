"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "b2_key", "b7_phone", "b18_date_order", "b23_catalog_match", "b30_money", "c4_availability",
    "c12_catalog", "c18_reconcile", "c20_nearest", "d4_duplicate_groups", "d18_sla",
    "d19_indicators", "e1_queue_position", "e3_dupes", "e4_latest", "e7_rolling",
    "h23_source_findings", "i1_cell_log", "j1_identity", "j5_context", "j12_ranked_context",
    "j14_assignment", "a14_upsert", "l3_publish", "l10_fold", "m3_visible", "k9_ap", "k12_top20",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from leadloom.plans import REGISTRY
    from leadloom.session import local_session

    spark = local_session(cores, cores)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
