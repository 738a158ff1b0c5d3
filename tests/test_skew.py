import pytest
from pyspark.sql import functions as F

from tallyweir.operators import skew


@pytest.fixture
def hot(spark):
    """3,000 rows: a third under one key, a third without key, the rest spread."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), n % 97))
    return spark.range(3000).select(key.cast("string").alias("k"), n.alias("n"))


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_heavy_keys_are_found_and_bounded(hot):
    assert set(skew.heavy_keys(hot, "k", min_rows=500, min_bytes=0)) == {"hot", None}
    assert skew.heavy_keys(hot, "k", min_rows=500, min_bytes=1 << 40) == []
    assert skew.heavy_keys(hot, "k", min_rows=5000, min_bytes=0) == []


@pytest.mark.parametrize("heavy", [(), ("hot",), ("hot", None), (None,), ("absent",)])
def test_lookup_is_the_left_join_whatever_is_heavy(hot, frame, heavy):
    right = frame("k string, v int", ("hot", 1), ("k5", 2), ("zz", 3))
    plain = hot.join(right, "k", "left")
    assert content(skew.left_lookup(hot, right, "k", heavy)) == content(plain)
    for salts in (1, 16):
        spread = skew.spread_lookup(hot, right, ["k"], ["n"], salts)
        assert content(spread.select("k", "n", "v")) == content(plain)


@pytest.mark.parametrize("heavy", [(), ("hot",), ("hot", "k5"), (None, "hot"), ("absent",), ("none", "hot")])
def test_fanout_is_the_left_join_whatever_is_heavy(hot, frame, heavy):
    left = frame("k string, x int", ("hot", 1), ("hot", 2), ("k5", 3), ("none", 4), (None, 5))
    expected = content(left.join(hot, "k", "left"))
    assert content(skew.left_fanout(left, hot, "k", heavy)) == expected
    assert len(expected) == 2 * 1000 + len([r for r in hot.collect() if r["k"] == "k5"]) + 2


@pytest.mark.parametrize("heavy", [(), ("hot", None)])
def test_members_never_fan_out(hot, frame, heavy):
    members = frame("k string", ("hot",), ("hot",), ("k5",), (None,))
    marked = skew.mark_members(hot, members, "k", "known", heavy)
    assert marked.columns == ["k", "n", "known"] and marked.count() == 3000
    assert {r["k"] for r in marked.where("known").collect()} == {"hot", "k5"}


@pytest.fixture
def eager_splitting(spark):
    """No broadcast, and partitions count as skewed when they are merely uneven."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_heavy_part_is_broadcast(eager_splitting, hot, frame):
    right = frame("k string, v int", ("hot", 1), ("k5", 2))
    plan = skew.left_lookup(hot, right, "k", ["hot"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan


def test_heavy_key_of_a_lookup_is_split_at_run_time(eager_splitting, spark, frame):
    # A wide left row, so that the heavy key outweighs the rest in bytes.
    n = F.col("id")
    left = spark.range(0, 20000, 1, 8).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), n)).alias("k"), n.alias("n")
    )
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    split, plan = final_plan(skew.spread_lookup(left, right, ["k"], ["n"]))
    assert "skew=true" in plan and len(split) == 20000 and all(r["v"] == 1 for r in split)
    # The same join without its own exchange cannot be split.
    _, plain = final_plan(left.join(right, "k", "left"))
    assert "skew=true" not in plain


def test_heavy_key_on_the_right_of_a_fanout_is_split(eager_splitting, spark):
    n = F.col("id")
    right = spark.range(0, 20000, 1, 8).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), n)).alias("k"), n.alias("n")
    )
    left = spark.range(0, 100, 1, 4).select(
        F.when(n == 0, "hot").otherwise(F.concat(F.lit("k"), n)).alias("k")
    )
    _, plain = final_plan(skew.left_fanout(left, right, "k"))
    assert "skew=true" not in plain
    rows, plan = final_plan(skew.left_fanout(left, right, "k", ["hot"]))
    assert "skew=true" in plan
    assert len([r for r in rows if r["k"] == "hot"]) == 6667
