from pyspark.sql import functions as F

from tallyweir.operators.quality import with_verdict
from tallyweir.sinks import tables as sinks


def test_split_write_needs_no_sort_and_counts_itself(spark, lake):
    tagged = with_verdict(spark.range(0, 1000, 1, 4), F.col("id") % 10 != 0)
    assert sinks.write_split(lake, tagged, "t", ["id"], ["id"]) == (1000, 900, 100)
    assert lake.read("t").columns == ["id"] and lake.read("t").count() == 900
    assert lake.read("quarantine_t").where("_quarantine_reason IS NULL").count() == 0
    folder = lake.read("t").inputFiles()[0].rsplit("/", 1)[0].removesuffix("/_is_valid=true")
    # Two files per task at most, straight from the scan.
    assert len(spark.read.parquet(folder).inputFiles()) == 8


def test_overwrite_keeps_the_superseded_folder_readable(lake, frame):
    sinks.overwrite(lake, frame("a int", (1,)), "t")
    old = lake.read("t")
    sinks.overwrite(lake, frame("a int", (2,), (3,)), "t")
    assert [r["a"] for r in old.collect()] == [1]
    assert sorted(r["a"] for r in lake.read("t").collect()) == [2, 3]


def test_vacuum_never_touches_what_a_name_points_at(spark, lake, frame):
    for n in range(4):
        sinks.overwrite(lake, frame("a int", (n,)), "t")
    tagged = with_verdict(spark.range(10), F.col("id") % 2 == 0)
    for _ in range(2):
        sinks.write_split(lake, tagged, "s", ["id"], ["id"])
    assert len(sinks.vacuum(lake, "t", keep=1)) == 2
    assert len(sinks.vacuum(lake, "s", keep=0)) == 1
    assert len(sinks.vacuum(lake, "t", keep=0)) == 1 and sinks.vacuum(lake, "t", keep=0) == []
    assert lake.read("t").first()["a"] == 3
    assert lake.read("s").count() == lake.read("quarantine_s").count() == 5
    assert sinks.vacuum(lake, "absent") == []


def test_side_by_side_returns_or_raises(lake):
    assert sinks.side_by_side(lake, {"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    try:
        sinks.side_by_side(lake, {"a": lambda: 1, "b": lambda: 1 / 0})
    except ZeroDivisionError:
        return
    raise AssertionError("the failure of one write must surface")
