import json
from datetime import datetime, timezone

import pytest

from tallyweir.plans import loading
from tallyweir.sources.tables import SourceUnavailable

AS_OF = datetime(2026, 2, 1, tzinfo=timezone.utc)


def test_seed_then_incremental_batch(lake, folder, rows):
    with pytest.raises(SourceUnavailable, match="transactions.*merchants"):
        loading.apply_incremental_batch(lake, 1, 25, AS_OF)
    for table in loading.TABLE_SCHEMAS:
        rows(table, {}).write.parquet(f"{folder}/in/{table}.parquet")
    assert loading.seed_from_files(lake, f"{folder}/in") == dict.fromkeys(loading.TABLE_SCHEMAS, 1)
    expected = {"transactions": 26, "transaction_risk_scores": 26, "merchants": 2}
    for _ in range(2):
        counted = loading.apply_incremental_batch(lake, 1, 25, AS_OF)
        assert {r["object"]: r["row_count"] for r in counted.collect()} == expected
    changed = lake.read("transaction_risk_scores").where("TransactionID = 'TXN-000000002'").first()
    assert changed["RiskScore"] == 88.0 and changed["ScoredTimestamp"] == datetime(2026, 2, 1)


def test_documents_load_from_files(spark, lake, folder):
    def write(name, documents):
        lines = [(json.dumps(d),) for d in documents]
        spark.createDataFrame(lines, "value string").write.text(f"{folder}/{name}/devices.jsonl")
    write("initial", [{"id": "D1", "customerId": "c", "trusted": True, "appVersion": "1"},
                      {"id": "D2", "customerId": "c"}])
    write("next", [{"id": "D1", "customerId": "c", "trusted": False}])
    assert set(loading.documents_in(spark, f"{folder}/initial")) == {"devices"}
    assert loading.documents_in(spark, f"{folder}/absent") == {}
    assert loading.upsert_into(lake, loading.documents_in(spark, f"{folder}/initial")) == {"devices": 2}
    assert loading.upsert_into(lake, loading.documents_in(spark, f"{folder}/next")) == {"devices": 2}
    device = lake.read("devices").where("id = 'D1'").first()
    assert device["trusted"] is False and device["appVersion"] is None


def test_the_last_line_of_a_loaded_file_wins(spark, lake, folder):
    for load, versions in enumerate((["zzz", "aaa"], ["b", "y", "c"])):
        lines = [(json.dumps({"id": "D1", "customerId": "c", "appVersion": v}),) for v in versions]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{folder}/{load}/devices.jsonl")
        loading.upsert_into(lake, loading.documents_in(spark, f"{folder}/{load}"))
        stored = lake.read("devices").collect()
        assert [r["appVersion"] for r in stored] == versions[-1:] and "_line" not in lake.read("devices").columns


def test_a_moment_without_zone_is_refused(spark):
    from tallyweir.plans import incremental

    for build in (lambda t: incremental.incremental_transactions(spark, 1, 1, t),
                  lambda t: incremental.incremental_changes(spark, t), lambda t: incremental.document_batch(spark, t)):
        with pytest.raises(ValueError, match="time zone"):
            build(datetime(2026, 2, 1))


def test_a_small_batch_does_not_shuffle_its_target(spark, lake, rows):
    from tallyweir.operators.merge import merge_update_matched
    from tallyweir.plans.incremental import incremental_changes
    from tallyweir.sinks.tables import overwrite

    overwrite(lake, rows("transaction_risk_scores", {}, {"TransactionID": "TXN-000000003"}), "scores")
    merged = merge_update_matched(lake.read("scores"), incremental_changes(spark, AS_OF).scores, "TransactionID")
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    target = plan[plan.index("FileScan"):]
    assert "Exchange" not in plan[plan.index("BroadcastHashJoin"):plan.index("BroadcastQueryStage")], target
