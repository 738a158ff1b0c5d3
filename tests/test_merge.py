from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyweir import model
from tallyweir.operators import merge
from tallyweir.plans import incremental

KV = "k string, v int"


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_insert_missing_is_idempotent_but_for_null_keys(frame):
    target = frame(KV, ("a", 1), ("b", 2))
    source = frame(KV, ("b", 9), ("c", 3), (None, 4))
    once = merge.merge_insert_missing(target, source, "k")
    assert content(once) == [("a", 1), ("b", 2), ("c", 3), (None, 4)]
    twice = merge.merge_insert_missing(once, source, "k")
    assert content(twice) == [("a", 1), ("b", 2), ("c", 3), (None, 4), (None, 4)]


def test_insert_missing_keeps_duplicate_source_rows(frame):
    merged = merge.merge_insert_missing(frame(KV, ("a", 1)), frame(KV, ("b", 1), ("b", 2), ("a", 3)), "k")
    assert content(merged) == [("a", 1), ("b", 1), ("b", 2)]


def test_update_matched(frame):
    target = frame(KV, ("a", 1), ("b", 2), (None, 3), ("b", 4))
    merged = merge.merge_update_matched(target, frame(KV, ("b", None), ("z", 9), (None, 8)), "k")
    assert content(merged) == [("a", 1), ("b", None), ("b", None), (None, 3)]


def test_ambiguous_update_stops_only_when_it_matches(frame):
    target = frame(KV, ("a", 1))
    assert content(merge.merge_update_matched(target, frame(KV, ("z", 1), ("z", 2)), "k")) == [("a", 1)]
    ambiguous = merge.merge_update_matched(target, frame(KV, ("a", 1), ("a", 2)), "k")
    with pytest.raises(Exception, match="several source rows match k a"):
        ambiguous.collect()
    with pytest.raises(Exception, match="several source rows match"):
        ambiguous.count()


DOC = "id string, customerId string, a string, b string"


def test_upsert_replaces_whole_documents(frame):
    target = frame(DOC, ("1", "c1", "x", "y"), ("2", "c1", "p", "q"))
    batch = frame("id string, customerId string, a string", ("1", "c1", "new"), ("3", "c1", "n"))
    assert content(merge.upsert_documents(target, batch)) == [
        ("1", "c1", "new", None), ("2", "c1", "p", "q"), ("3", "c1", "n", None)
    ]


def test_upsert_under_another_partition_key_is_another_document(frame):
    merged = merge.upsert_documents(frame(DOC, ("1", "c1", "x", "y")), frame(DOC, ("1", "c2", "g", "h")))
    assert merged.count() == 2


def test_last_write_of_a_batch_wins(frame):
    batch = frame(DOC + ", seq int", ("1", "c1", "late", None, 3), ("1", "c1", "zz", "zz", 1), ("1", "c1", "mid", "m", 2))
    merged = merge.upsert_documents(frame(DOC, ("1", "c1", "x", "y")), batch, ["seq"])
    assert content(merged) == [("1", "c1", "late", None)]
    assert merged.columns == ["id", "customerId", "a", "b"]


def test_snapshot_changes(frame):
    before = frame(KV, ("same", 1), ("null", None), ("gone", 1), ("set", 1), ("twice", 1), ("twice", 2))
    after = frame(KV, ("same", 1), ("null", None), ("new", 1), ("set", None), ("twice", 2), ("twice", 1))
    assert content(merge.snapshot_changes(before, after, "k")) == [
        ("gone", "delete"), ("new", "insert"), ("set", "update")
    ]
    swapped = merge.snapshot_changes(
        frame("k string, a string, b string", ("x", "1", None)),
        frame("k string, a string, b string", ("x", None, "1")), "k",
    )
    assert content(swapped) == [("x", "update")]


def test_snapshot_changes_see_microseconds_and_refuse_other_columns(frame):
    at = lambda micro: datetime(2026, 1, 31, 5, 0, 0, micro)
    schema = "k string, at timestamp"
    changed = merge.snapshot_changes(frame(schema, ("x", at(123456)), ("y", at(1))), frame(schema, ("x", at(123999)), ("y", at(1))), "k")
    assert content(changed) == [("x", "update")]
    with pytest.raises(ValueError, match="columns"):
        merge.snapshot_changes(frame(KV, ("a", 1)), frame("k string, w int", ("a", 1)), "k")


def test_a_small_batch_leaves_the_target_unshuffled(spark, frame):
    target = spark.range(0, 2_000_000, 1, 4).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"))
    source = frame(KV, ("5", 1), ("new", 2))
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # The target's keys meet the batch's in a broadcast; only the few that are found travel.
    semi = next(line for line in plan_of(merge.merge_insert_missing(target, source, "k")).splitlines() if "LeftSemi" in line)
    assert "BroadcastHashJoin" in semi
    assert "SortMergeJoin" not in plan_of(merge.merge_update_matched(target, source, "k"))
    assert merge.merge_insert_missing(target, source, "k").count() == 2_000_001


AS_OF = datetime(2026, 2, 1, tzinfo=timezone.utc)


def test_incremental_batch_is_deterministic_and_idempotent(spark, sources):
    tables = sources(
        transactions=[{}, {"TransactionID": "TXN-000000002"}],
        transaction_risk_scores=[{}, {"TransactionID": "TXN-000000002"}], merchants=[{}],
    )
    def batches():
        return (incremental.incremental_transactions(spark, 2, 25, AS_OF),
                incremental.incremental_changes(spark, AS_OF))
    once = incremental.apply_table_batches(tables, *batches())
    twice = incremental.apply_table_batches(once, *batches())
    for name, expected in (("transactions", 27), ("transaction_risk_scores", 27), ("merchants", 2)):
        assert once[name].count() == expected
        assert content(once[name]) == content(twice[name])
    new = once["transactions"].where("TransactionID = 'TXN-000000003'").first()
    assert new["CustomerID"].startswith("CUST-") and 1.0 <= new["Amount"] <= 2500.0
    changed = once["transaction_risk_scores"].where("TransactionID = 'TXN-000000001'").first()
    assert (changed["RiskScore"], changed["RiskBand"]) == (91.25, "Critical")
    with pytest.raises(ValueError):
        incremental.incremental_transactions(spark, 0, 25, AS_OF)


def test_document_batch_turns_sessions_into_anomalies(spark, sources, profile_of):
    given = dict(digitalSessions=[{}], devices=[{"geoHistory": '[{"country":"US"}]'}], fraudAlerts=[{}])
    assert profile_of(**given)["CUST-000001"]["GeographicAnomalyCount"] == 0
    containers = {name: df for name, df in sources(**given).items() if name in model.DOCUMENT_SOURCES}
    after = incremental.apply_document_batch(containers, incremental.document_batch(spark, AS_OF))
    assert {name: df.count() for name, df in after.items()} == {
        "digitalSessions": 2, "devices": 1, "fraudAlerts": 2
    }
    device = after["devices"].first()
    # The replacement knows only GB, so the earlier US session is now outside the history.
    assert device["trusted"] is False and device["changeType"] == "update"
    again = incremental.apply_document_batch(after, incremental.document_batch(spark, AS_OF))
    for name in after:
        assert content(again[name]) == content(after[name])
    from tallyweir.plans.gold import build_gold
    from tallyweir.plans.silver import build_silver, flat_frames
    silver = flat_frames(build_silver({**sources(**given), **after}))
    profile = build_gold(silver)["aggcustomerriskprofile"].first()
    assert profile["GeographicAnomalyCount"] == 1 and profile["UntrustedDeviceCount"] == 1
    assert profile["FraudAlertCount"] == 2 and profile["FailedLoginCount"] == 1
    changed = after["fraudAlerts"].where(F.col("id") == "ALERT-00000001").first()
    assert changed["status"] == "investigating" and changed["resolution"] is None


def test_versions_are_dealt_out_before_the_fold_and_a_key_meets_after_it(frame):
    versions = frame("id string, customerId string, x int, n int", ("a", "c", 1, 1), ("a", "c", 2, 3), ("a", "c", 3, 2))
    latest = merge.latest_documents(versions, ["n"])
    assert [r["x"] for r in latest.collect()] == [2] and latest.columns == ["id", "customerId", "x"]
    plan = latest._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions [_dealt" in plan
