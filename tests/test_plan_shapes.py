"""What the physical plans must look like for the data to grow."""

import re

import pytest
from pyspark.sql import functions as F

from tallyweir.frames import Frames
from tallyweir.operators import customer_metrics
from tallyweir.operators.windows import last_day, start_before, trailing_window, window_start
from tallyweir.queries import QUERIES
from tallyweir.sinks import tables as sinks

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_query_runs_python_per_row_or_all_pairs(spark):
    for name in ("j05_risk_profile", "p09_j02_fact_transactions", "f11_outside_history", "m02_merge_update_matched",
                 "m07_snapshot_changes", "j07_i04_fraud_investigation", "v03_v07_table_checks"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_profile_shuffles_once_on_the_customer(spark, unbroadcast):
    plan = plan_of(QUERIES["j05_risk_profile"](spark, SF_DIR))
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    by_customer = [k for k in keys if re.fullmatch(r"customerid#\d+", k, re.IGNORECASE)]
    assert len(by_customer) == 1
    # The one fact join; everything else is aggregated before it moves.
    assert sum("TransactionID" in k for k in keys) == 2
    assert "CustomerID" in plan and plan.count("SortMergeJoin") == 2


def test_clock_subquery_reads_no_join(spark):
    frames = Frames(spark, SF_DIR)
    day = frames.fact_transactions.select(F.max("TransactionTimestamp"))
    assert "Join" not in plan_of(day)


def scanned_rows(df) -> int:
    """Rows the file scans of an executed plan handed on."""
    total = 0
    pending = [df._jdf.queryExecution().executedPlan()]
    while pending:
        node = pending.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        elif name.startswith("AdaptiveSparkPlan"):
            pending.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            pending.append(node.plan())
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.mark.parametrize("known", [False, True])
def test_window_skips_most_of_a_file_in_time_order(spark, lake, known):
    stored = spark.range(0, 1_000_000, 1, 2).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    sinks.overwrite(lake, stored.sortWithinPartitions("ts"), "t")
    table = lake.read("t")
    start = start_before(table.agg(last_day("ts")).first()[0], 7) if known else window_start(table, "ts", 7)
    kept = trailing_window(table, "ts", start, 7)
    assert len(kept.collect()) == 6 * 24 * 60 + 1_000_000 % (24 * 60)
    assert scanned_rows(kept) < 100_000


def test_scans_read_only_what_is_used(spark):
    frames = Frames(spark, SF_DIR)
    plan = plan_of(customer_metrics.alert_metrics(frames.unlinked_alerts))
    assert "props" not in plan and "value#" not in plan
