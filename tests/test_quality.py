import pytest
from pyspark.sql import functions as F

from tallyweir.functions.casting import cast_if_present, quoted_identifier
from tallyweir.operators.quality import REASON, RULE_VIOLATION, VALID, quarantine_split, with_verdict
from tallyweir.plans.silver import refresh_silver, silver_split, typed


def ids(df, column):
    return sorted((r[0] for r in df.select(column).collect()), key=str)


@pytest.mark.parametrize("change, valid", [
    ({"Amount": 0.0}, True),
    ({"TransactionID": "TXN-1"}, False),
    ({"TransactionID": "txn-000000001"}, False),
    ({"TransactionID": None}, False),
    ({"TransactionID": "TXN-000000001\n"}, False),
    ({"TransactionID": "XTXN-000000001"}, False),
    ({"CustomerID": None}, False),
    ({"TransactionTimestamp": None}, False),
    ({"Amount": -0.01}, False),
    ({"Amount": None}, False),
    ({"Amount": float("nan")}, True),
])
def test_transactions_rule(rows, change, valid):
    split = silver_split("transactions", rows("transactions", change))
    assert (split.valid.count(), split.quarantined.count()) == ((1, 0) if valid else (0, 1))


def test_unreadable_timestamp_is_quarantined_not_raised(rows):
    source = rows("transactions", {}, {"TransactionID": "TXN-000000002"}).withColumn(
        "TransactionTimestamp",
        F.when(F.col("TransactionID") == "TXN-000000001", "abc").otherwise("2026-01-01 00:00:00"),
    )
    split = silver_split("transactions", source)
    assert ids(split.valid, "TransactionID") == ["TXN-000000002"]
    assert ids(split.quarantined, "TransactionID") == ["TXN-000000001"]
    assert dict(split.valid.dtypes)["TransactionTimestamp"] == "timestamp"


def test_risk_bounds_and_orphans(rows):
    transactions = rows(
        "transactions", *({"TransactionID": f"TXN-00000000{i}"} for i in range(1, 7)),
        {"TransactionID": "TXN-000000007", "Amount": -1.0},
    )
    scores = [0.0, 100.0, 100.01, -0.01, None, float("nan"), 50.0, 50.0]
    risk = rows("transaction_risk_scores", *(
        {"TransactionID": f"TXN-00000000{i}", "RiskScore": s} for i, s in enumerate(scores, 1)
    ))
    valid = silver_split("transactions", transactions).valid
    split = silver_split("transaction_risk", risk, valid)
    assert ids(split.valid, "TransactionID") == ["TXN-000000001", "TXN-000000002"]
    # 7 belongs to a quarantined transaction, 8 to none.
    assert split.quarantined.count() == 6
    assert split.valid.columns == risk.columns
    assert split.quarantined.columns == [*risk.columns, REASON]


def test_merchants_rule(rows):
    split = silver_split("merchants", rows("merchants", {}, {"MerchantCategory": None}, {"MerchantID": None}))
    assert (split.valid.count(), split.quarantined.count()) == (1, 2)


def test_sessions_flatten_and_quarantine_keeps_documents(rows):
    split = silver_split("sessions", rows(
        "digitalSessions",
        {"sessionId": "a", "device": '{"deviceId":',
         "authentication": '{"method":"m","failedAttempts":"x"}'},
        {"sessionId": "b", "geo": None},
        {"sessionId": None}, {"customerId": None},
    ))
    found = {r["sessionId"]: r for r in split.valid.collect()}
    assert set(found) == {"a", "b"}
    assert found["a"]["device_deviceId"] is None
    assert found["a"]["auth_failedAttempts"] is None and found["a"]["auth_mfaUsed"] is None
    assert found["a"]["auth_method"] == "m"
    assert found["b"]["geo_country"] is None and found["b"]["auth_mfaUsed"] is True
    assert not {"device", "geo", "authentication"} & set(split.valid.columns)
    assert {"device", "geo", "authentication", REASON} <= set(split.quarantined.columns)
    assert "device_deviceId" not in split.quarantined.columns
    assert {r[REASON] for r in split.quarantined.collect()} == {RULE_VIOLATION}


@pytest.mark.parametrize("severity, valid", [("High", 0), ("critical", 1), (None, 0), ("unknown", 0)])
def test_alert_severity(rows, severity, valid):
    assert silver_split("fraud_alerts", rows("fraudAlerts", {"severity": severity})).valid.count() == valid


def test_split_is_a_partition_and_verdict_agrees(frame):
    df = frame("x int", (1,), (-1,), (None,))
    split = quarantine_split(df, F.col("x") > 0, "why")
    assert split.valid.count() + split.quarantined.count() == 3
    assert [r["_quarantine_reason"] for r in split.quarantined.collect()] == ["why", "why"]
    tagged = with_verdict(df, F.col("x") > 0, "why")
    assert {(r["x"], r[VALID], r[REASON]) for r in tagged.collect()} == {
        (1, True, None), (-1, False, "why"), (None, False, "why")
    }


def test_written_silver_equals_lazy_silver(lake, sources):
    given = sources(
        transactions=[{}, {"TransactionID": "bad"}],
        transaction_risk_scores=[{}, {"RiskScore": 101.0}],
        merchants=[{}], digitalSessions=[{}, {"sessionId": None}], devices=[{}], fraudAlerts=[{}],
    )
    counts = refresh_silver(lake, given)
    assert counts["transactions"] == (2, 1, 1) and counts["devices"] == (1, 1, 0)
    # An empty quarantine table still exists.
    assert lake.read("quarantine_devices").count() == 0
    valid = silver_split("transactions", given["transactions"]).valid
    for table, source in (("sessions", "digitalSessions"), ("transaction_risk", "transaction_risk_scores")):
        split = silver_split(table, given[source], valid)
        for name, half in ((table, split.valid), (f"quarantine_{table}", split.quarantined)):
            written = lake.read(name)
            assert written.columns == half.columns
            assert written.collect() == half.collect()


def test_cast_if_present(frame):
    df = frame("a string", ("1",), ("x",))
    assert [r[0] for r in cast_if_present(df, "A", "int").collect()] == [1, None]
    assert cast_if_present(df, "b", "int") is df
    assert typed("devices", df) is df


def test_identifier():
    assert quoted_identifier("banking_1") == "`banking_1`"
    for bad in ("", "1a", "a b", "a`", "a;drop", "a" * 256, "a\n"):
        with pytest.raises(ValueError):
            quoted_identifier(bad)
