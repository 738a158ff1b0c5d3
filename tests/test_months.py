"""Facts by month: which partitions a trailing window opens."""

import pytest
from pyspark.sql import functions as F

from tallyweir.operators.months import MONTH, recent, recent_before
from tallyweir.operators.windows import trailing_window, window_start
from tallyweir.sinks import tables as sinks


@pytest.fixture
def year(spark, lake):
    """A row each hour of a year that ends on a 3rd, and one without a moment."""
    rows = spark.range(0, 24 * 365).selectExpr("id", "timestamp '2026-03-03 23:00:00' - make_dt_interval(0, cast(id as int)) AS ts")
    rows = rows.unionByName(spark.sql("SELECT -1L AS id, cast(NULL as timestamp) AS ts"))
    written = sinks.write_by_month(lake, rows, "facts", "ts")
    assert written["rows"] == 24 * 365 + 1
    return rows, written["last"]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def opened(df):
    """(partitions, rows) that the widest scan of an executed plan opened and handed on."""
    found, pending = [], [executed(df)]
    while pending:
        node = pending.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            metrics = node.metrics()
            found.append((metrics.apply("numPartitions").value(), metrics.apply("numOutputRows").value()))
        elif name.startswith("AdaptiveSparkPlan"):
            pending.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            pending.append(node.plan())
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


@pytest.mark.parametrize("days", [1, 3, 7, 31, 40, 400])
def test_window_equals_the_one_over_all_rows(lake, year, days):
    rows, last = year
    wanted = {r.id for r in trailing_window(rows, "ts", window_start(rows, "ts", days), days).collect()}
    table = lake.read("facts")
    assert {r.id for r in recent(table, "ts", days).collect()} == wanted
    assert {r.id for r in recent_before(table, "ts", last, days).collect()} == wanted


def test_a_week_opens_two_months_at_most(lake, year):
    _, last = year
    table = lake.read("facts")
    plan = executed(recent(table, "ts", 7)).toString()
    filters = plan.split("PartitionFilters: [")[1].split("DataFilters")[0]
    assert MONTH in filters and "subquery" in filters.lower()
    for week in (recent(table, "ts", 7), recent_before(table, "ts", last, 7)):
        partitions, rows = opened(week)
        assert partitions == 2 and rows <= 24 * 31 + 72
    assert opened(recent(table, "ts", 3))[0] == 1


def test_months_hold_their_rows_in_order(lake, year):
    table = lake.read("facts")
    assert {r[0] for r in table.select(MONTH).distinct().collect()} == {None, *range(202503, 202513), 202601, 202602, 202603}
    assert table.where(F.col(MONTH) != F.year("ts") * 100 + F.month("ts")).isEmpty()
    assert len(table.inputFiles()) == 14


def test_windows_on_an_empty_fact(spark, lake):
    rows = spark.sql("SELECT 1L AS id, timestamp '2026-01-01' AS ts WHERE false")
    assert sinks.write_by_month(lake, rows, "none", "ts") == {"rows": 0, "last": None}
    table = lake.read("none")
    assert recent(table, "ts", 7).count() == 0 and recent_before(table, "ts", None, 7).count() == 0
