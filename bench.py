"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times; the median counts. A run writes to
the ``noop`` sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyweir.queries import QUERIES
from tallyweir.session import local_session

HEADLINE = (
    "j05_risk_profile",
    "j05_risk_profile_week",
    "p09_j02_fact_transactions",
    "p07_fact_sessions",
    "f03_j01_risk_rule",
    "f02_transactions_rule",
    "f09_a12_u01_customer_spine",
    "a06_geographic_anomalies",
    "j07_i04_fraud_investigation",
    "i03_j06_l01_top_risk_customers",
    "m01_merge_insert_missing",
    "m02_merge_update_matched",
    "m03_document_upsert",
    "m07_snapshot_changes",
    "v03_v07_table_checks",
    "r01_r04_reconciliation",
    "e1_full_refresh",
)


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "tallyweir-bench")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
