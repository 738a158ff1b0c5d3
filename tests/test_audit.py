from datetime import datetime, timezone

import pytest
from conftest import DAY
from pyspark.sql import functions as F

from tallyweir import model
from tallyweir.operators.checks import CheckFailed
from tallyweir.plans import audit, refresh
from tallyweir.sinks import tables as sinks
from tallyweir.sources.tables import SourceUnavailable

FULL = dict(
    transactions=[{}, {"TransactionID": "TXN-000000002"}, {"TransactionID": "bad"}],
    transaction_risk_scores=[{}, {"TransactionID": "TXN-000000002", "RiskScore": 101.0}],
    merchants=[{}], digitalSessions=[{}], devices=[{}], fraudAlerts=[{"transactionId": "TXN-000000001"}],
)


@pytest.fixture
def lakes(spark, lake, folder):
    return refresh.Lakes(
        lake, sinks.open_lake(spark, lake.schema + "_gold", folder),
        sinks.open_lake(spark, lake.schema + "_serving", folder),
    )


def stages(lakes):
    log = lakes.gold.read(audit.RUN_LOG_TABLE)
    return {r["stage"]: r for r in log.collect()}


def test_run_log_row(spark):
    row = audit.run_log_row(spark, "r", "s", "Succeeded", "2026-01-31T00:00:00+00:00", error_message="").first()
    assert row["error_message"] is None and row["run_date"] == f"{datetime.now(timezone.utc):%Y-%m-%d}"
    assert audit.run_log_row(spark, "r", "s", "Failed").columns == model.RUN_LOG.names
    with pytest.raises(ValueError):
        audit.run_log_row(spark, "r", "s", "Done")


def test_refresh_reconciles(lakes, sources):
    views = refresh.run_medallion(lakes, sources(**FULL), "r1", "2026-01-31", DAY)
    results = lakes.gold.read(audit.RECONCILIATION_TABLE)
    assert results.count() == 20 and results.where("status = 'FAIL'").count() == 0
    log = stages(lakes)
    assert len(log) == 7 and {r["status"] for r in log.values()} == {"Succeeded"}
    assert (log["silver_transform"]["rows_read"], log["silver_transform"]["rows_written"]) == (9, 7)
    assert log["gold_build"]["rows_read"] == 7
    assert views["dimcustomer"].first()["CustomerID"] == "CUST-XXXXXX"
    assert set(views) == set(model.GOLD_TABLES)
    assert lakes.gold.spark.table(f"{lakes.serving.schema}_factfraudalerts").count() == 1
    counts = refresh.run_consumption(lakes, DAY)
    assert counts == {"demo_table_inventory": 21, "demo_top_risk_customers": 1, "demo_fraud_investigation": 1}
    assert lakes.gold.read("demo_top_risk_customers").first()["_demo_run_at"] == DAY


def test_second_cycle_replaces_silver_and_appends_audit(lakes, sources):
    refresh.run_medallion(lakes, sources(**FULL), "r1", "2026-01-31")
    more = {**FULL, "transactions": [*FULL["transactions"], {"TransactionID": "TXN-000000003"}]}
    refresh.run_medallion(lakes, sources(**more), "r2", "2026-02-01")
    assert lakes.silver.read("transactions").count() == 3
    assert lakes.gold.read(audit.RECONCILIATION_TABLE).count() == 40


def test_both_sources_are_checked_then_the_run_stops(lakes, sources):
    given = {**sources(**{**FULL, "devices": []}), "merchants": None}
    with pytest.raises(SourceUnavailable, match="merchants"):
        refresh.run_medallion(lakes, given, "r1", "2026-01-31")
    log = stages(lakes)
    assert {s: r["status"] for s, r in log.items()} == {
        "source_validation_tables": "Failed", "source_validation_documents": "Failed"
    }
    assert "devices" in log["source_validation_documents"]["error_message"]


def test_empty_alert_fact_blocks_publishing(lakes, sources):
    given = {**FULL, "fraudAlerts": [{"severity": "none"}]}
    with pytest.raises(CheckFailed, match="factfraudalerts"):
        refresh.run_medallion(lakes, sources(**given), "r1", "2026-01-31")
    assert stages(lakes)["warehouse_publish"]["status"] == "Failed"
    assert "reconciliation" not in stages(lakes)


def test_duplicate_score_fails_reconciliation_after_recording(lakes, sources):
    given = {**FULL, "transaction_risk_scores": [{}, {"RiskScore": 60.0}]}
    with pytest.raises(audit.ReconciliationFailed):
        refresh.run_medallion(lakes, sources(**given), "r1", "2026-01-31")
    failed = lakes.gold.read(audit.RECONCILIATION_TABLE).where("status = 'FAIL'").collect()
    assert [(r["object"], r["source_count"], r["target_count"]) for r in failed] == [
        ("transactions->facttransactions", 2, 3)
    ]
    assert "pipeline_complete" not in stages(lakes)


def test_failed_overwrite_leaves_the_old_version(lake, frame):
    sinks.overwrite(lake, frame("a int", (1,)), "t")
    broken = lake.read("t").selectExpr("raise_error('no') AS a")
    with pytest.raises(Exception):
        sinks.overwrite(lake, broken, "t")
    assert lake.read("t").count() == 1
    # Reads the table it replaces, under a new schema.
    wider = lake.read("t").selectExpr("a", "a + 1 AS b")
    assert sinks.overwrite(lake, wider, "t", most=F.max("b")) == {"rows": 1, "most": 2}
    assert lake.read("t").columns == ["a", "b"]


def test_seed_is_rerunnable(lake, frame):
    given = {"x": frame("a int", (1,), (2,))}
    assert sinks.seed_tables(lake, given) == sinks.seed_tables(lake, given) == {"x": 2}
    assert lake.read("x").count() == 2
