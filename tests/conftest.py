import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import types as T  # noqa: E402

from tallyweir import model  # noqa: E402
from tallyweir.session import local_session, shared_folder  # noqa: E402
from tallyweir.sinks.tables import open_lake  # noqa: E402
from tallyweir.sources.tables import rows_frame  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tallyweir-tests")


@pytest.fixture
def folder(spark):
    return shared_folder(spark, "test")


@pytest.fixture
def lake(spark, folder):
    return open_lake(spark, "t_" + folder.rsplit("-", 1)[1][:12], folder)


@pytest.fixture
def frame(spark):
    """``frame("a int, b string", (1, "x"), ...)``."""
    return lambda schema, *rows: rows_frame(spark, rows, T.StructType.fromDDL(schema))


def _rows(spark, schema: T.StructType, dicts):
    rows = [tuple(d.get(name) for name in schema.names) for d in dicts]
    return rows_frame(spark, rows, schema)


DAY = datetime(2026, 1, 31)

TRANSACTION = {
    "TransactionID": "TXN-000000001", "AccountID": "ACCT000000001", "CustomerID": "CUST-000001",
    "MerchantID": "MER000001", "TransactionTimestamp": DAY, "Amount": 10.0, "Currency": "USD",
    "DeviceID": "DEV-000001", "CardPresent": True,
}
SCORE = {
    "TransactionID": "TXN-000000001", "RiskScore": 50.0, "RiskBand": "Medium", "ModelVersion": "v1",
    "ScoredTimestamp": DAY,
}
MERCHANT = {"MerchantID": "MER000001", "MerchantName": "M", "MerchantCategory": "C"}
SESSION = {
    "id": "SESSION-000000001", "sessionId": "SESSION-000000001", "customerId": "CUST-000001",
    "device": '{"deviceId":"DEV-000001"}', "geo": '{"country":"US"}',
    "authentication": '{"method":"password","mfaUsed":true,"failedAttempts":0}',
    "loginTimestamp": "2026-01-31T10:00:00.000Z", "logoutTimestamp": "2026-01-31T10:09:00.000Z",
    "activities": "[]",
}
DEVICE = {
    "id": "DEV-000001", "deviceId": "DEV-000001", "customerId": "CUST-000001", "trusted": True,
    "deviceFingerprint": "FP", "operatingSystem": "iOS", "geoHistory": '[{"country":"US"}]',
}
ALERT = {
    "id": "ALERT-00000001", "alertId": "ALERT-00000001", "customerId": "CUST-000001",
    "createdTimestamp": "2026-01-31T09:00:00.000Z", "severity": "high", "alertType": "velocity",
}

DEFAULTS = {
    "transactions": (TRANSACTION, model.TRANSACTIONS),
    "transaction_risk_scores": (SCORE, model.RISK_SCORES),
    "merchants": (MERCHANT, model.MERCHANTS),
    "digitalSessions": (SESSION, model.DOCUMENTS["digitalSessions"]),
    "devices": (DEVICE, model.DOCUMENTS["devices"]),
    "fraudAlerts": (ALERT, model.DOCUMENTS["fraudAlerts"]),
}


@pytest.fixture
def rows(spark):
    """``rows("devices", {"trusted": False}, ...)``: one default row per dict, with its changes."""
    def build(source, *changes):
        default, schema = DEFAULTS[source]
        return _rows(spark, schema, [{**default, **change} for change in changes])
    return build


@pytest.fixture
def sources(rows):
    """All six sources; each keyword replaces one, as a list of changes to its default row."""
    return lambda **given: {name: rows(name, *given.get(name, [])) for name in DEFAULTS}


@pytest.fixture
def profile_of(sources):
    """The profile of hand-made sources as {customer: row dict}."""
    from tallyweir.plans.gold import build_gold
    from tallyweir.plans.silver import build_silver, flat_frames

    def build(days=30, **given):
        tables = build_gold(flat_frames(build_silver(sources(**given))), days)
        return {r["CustomerID"]: r.asDict() for r in tables["aggcustomerriskprofile"].collect()}
    return build
