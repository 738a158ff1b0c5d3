import time
from datetime import timedelta

import pytest
from conftest import DAY
from pyspark.sql import functions as F

from tallyweir.functions import rules
from tallyweir.operators import customer_metrics as metrics
from tallyweir.operators.windows import as_of_date, last_day, start_before, trailing_window, window_start
from tallyweir.plans import gold, silver
from tallyweir.plans.risk_profile import scored_profile


def test_window_edges(frame):
    df = frame("n int, ts timestamp", *((n, DAY - timedelta(days=n)) for n in (0, 29, 30)),
               (100, DAY + timedelta(hours=23)))
    assert df.select(as_of_date(df, "ts")).first()[0] == DAY.date()
    for start in (window_start(df, "ts"), start_before(df.agg(last_day("ts")).first()[0])):
        assert {r["n"] for r in trailing_window(df, "ts", start).collect()} == {0, 29, 100}


def test_window_of_nothing(frame):
    df = frame("n int, ts timestamp", (1, None))
    for start in (window_start(df, "ts"), start_before(None)):
        assert trailing_window(df, "ts", start).count() == 0


def test_no_sessions_means_no_document_metrics(profile_of):
    found = profile_of(transactions=[{}], fraudAlerts=[{}])["CUST-000001"]
    assert found["TransactionCount30D"] == 1 and found["FraudAlertCount"] == 0


def test_sources_keep_their_own_clocks(profile_of):
    found = profile_of(
        transactions=[{}],
        digitalSessions=[{"loginTimestamp": "2029-05-01T00:00:00.000Z",
                          "authentication": '{"failedAttempts":3}'}],
        fraudAlerts=[{"createdTimestamp": "2029-05-01T23:59:59.000Z"},
                     {"createdTimestamp": "2029-05-02T00:00:00.000Z"}],
    )["CUST-000001"]
    assert found["TransactionCount30D"] == 1
    assert found["FailedLoginCount"] == 1
    # The alert a day after the last session is not counted.
    assert found["FraudAlertCount"] == 1


def test_geographic_anomalies(profile_of):
    session = lambda country, device="DEV-000001": {
        "device": f'{{"deviceId":"{device}"}}',
        "geo": "{}" if country is None else f'{{"country":"{country}"}}',
    }
    found = profile_of(
        digitalSessions=[
            session("US"), session("GB"), session("GB"), session(None),
            session("GB", "DEV-000002"), session("GB", "DEV-000003"), session("GB", "DEV-000004"),
            session("FR", "DEV-000005"), session("FR", "DEV-000006"),
        ],
        devices=[
            {},
            {"deviceId": "DEV-000002", "geoHistory": None},
            {"deviceId": "DEV-000003", "geoHistory": "[]"},
            {"deviceId": "DEV-000004", "geoHistory": '[{"country":'},
            # A history that names no country is a history: every known country is outside it.
            {"deviceId": "DEV-000005", "geoHistory": '[{"state":"NY"}]'},
            # Two rows of one device pool their countries.
            {"deviceId": "DEV-000006"}, {"deviceId": "DEV-000006", "geoHistory": '[{"country":"FR"}]'},
        ],
    )["CUST-000001"]
    assert found["GeographicAnomalyCount"] == 2
    assert found["DistinctDeviceCount"] == 6


def test_home_countries_is_a_set(rows):
    home = metrics.device_home_countries(rows(
        "devices", {"geoHistory": '[{"country":"US"},{"country":"GB"},{"country":"US"}]'},
        {"deviceId": "DEV-000002", "geoHistory": '[{"state":"NY"}]'}, {"deviceId": "D3", "geoHistory": None},
    ))
    assert {r["DeviceID"]: sorted(r["HomeCountries"]) for r in home.collect()} == {
        "DEV-000001": ["GB", "US"], "DEV-000002": []
    }


def test_only_untrusted_counts(profile_of):
    found = profile_of(
        digitalSessions=[{"device": f'{{"deviceId":"DEV-00000{i}"}}'} for i in (1, 2, 3, 3)],
        devices=[{"deviceId": "DEV-000001", "trusted": True}, {"deviceId": "DEV-000002", "trusted": None},
                 {"deviceId": "DEV-000003", "trusted": False}, {"deviceId": "DEV-000003", "trusted": True}],
    )["CUST-000001"]
    assert found["UntrustedDeviceCount"] == 1


def test_spine_is_the_union_of_all_sources(profile_of):
    found = profile_of(
        transactions=[{"CustomerID": "CUST-000001"}],
        digitalSessions=[{"customerId": "CUST-000002"},
                         {"customerId": "CUST-000005", "loginTimestamp": "2020-01-01T00:00:00.000Z"}],
        devices=[{"customerId": "CUST-000003"}],
        fraudAlerts=[{"customerId": "CUST-000004"}],
    )
    assert set(found) == {f"CUST-00000{i}" for i in range(1, 6)}
    quiet = found["CUST-000003"]
    assert quiet["AverageTransactionRiskScore"] is None
    assert quiet["TotalTransactionAmount30D"] == 0.0 and quiet["CustomerRiskScore"] == 0.0
    assert quiet["CustomerRiskBand"] == "Low"
    assert found["CUST-000005"]["DistinctDeviceCount"] == 0


def test_nan_amount_totals_zero(profile_of):
    assert profile_of(transactions=[{"Amount": float("nan")}])["CUST-000001"]["TotalTransactionAmount30D"] == 0.0


def test_scores_and_high_risk_count(profile_of):
    found = profile_of(
        transactions=[{"TransactionID": f"TXN-00000000{i}"} for i in range(1, 5)],
        transaction_risk_scores=[
            {"TransactionID": "TXN-000000001", "RiskScore": 90.0, "RiskBand": "Critical"},
            {"TransactionID": "TXN-000000002", "RiskScore": 70.0, "RiskBand": "High"},
            {"TransactionID": "TXN-000000003", "RiskScore": 20.0, "RiskBand": None},
            {"TransactionID": "TXN-000000004", "RiskScore": 120.0, "RiskBand": "Critical"},
        ],
    )["CUST-000001"]
    assert found["TransactionCount30D"] == 4
    assert found["HighRiskTransactionCount"] == 2
    assert found["AverageTransactionRiskScore"] == pytest.approx(60.0)
    assert found["CustomerRiskScore"] == 27.0


_METRICS = (
    "CustomerID string, TransactionCount30D bigint, TotalTransactionAmount30D double, "
    "AverageTransactionRiskScore double, HighRiskTransactionCount bigint, FraudAlertCount bigint, "
    "FailedLoginCount bigint, DistinctDeviceCount bigint, UntrustedDeviceCount bigint, "
    "GeographicAnomalyCount bigint"
)


@pytest.mark.parametrize("average, alerts, failed, untrusted, places, score, band", [
    (100.0, 3, 10, 5, 9, 100.0, "High"),
    # 24 + 12 + 10 = 46 from capped signals, 33.995 and 34.0 from the average.
    (33.995 / 0.45, 2, 6, 2, 0, 80.0, "High"),
    (100.0, 0, 0, 0, 0, 45.0, "Medium"),
    (44.994 / 0.45, 0, 0, 0, 0, 44.99, "Low"),
    (None, 1, 1, 1, 1, 22.0, "Low"),
])
def test_score_and_band(frame, average, alerts, failed, untrusted, places, score, band):
    row = ("c", 0, 0.0, average, 0, alerts, failed, 0, untrusted, places)
    found = scored_profile(frame(_METRICS, row)).first()
    assert (found["CustomerRiskScore"], found["CustomerRiskBand"]) == (score, band)


def test_account_under_two_customers(rows):
    dim = gold.dim_account(rows("transactions", {}, {}, {"CustomerID": "CUST-000002"}))
    assert dim.count() == 2 and dim.select("AccountSK").distinct().count() == 1


def test_two_scores_fan_out(rows):
    fact = gold.fact_transactions(
        rows("transactions", {}, {"TransactionID": "TXN-000000002"}),
        rows("transaction_risk_scores", {}, {"RiskScore": 60.0}),
    )
    assert sorted((r["TransactionID"], r["RiskScore"]) for r in fact.collect() if r["RiskScore"]) == [
        ("TXN-000000001", 50.0), ("TXN-000000001", 60.0)
    ]
    assert fact.count() == 3
    assert len(fact.columns) == 17


def test_fact_needs_no_membership_join(rows):
    transactions = rows("transactions", {}, {"TransactionID": "bad"}, {"TransactionID": "TXN-000000003"})
    risk = rows("transaction_risk_scores", {}, {"RiskScore": 101.0}, {"TransactionID": "bad"},
                {"TransactionID": "TXN-000000009"}, {"TransactionID": "TXN-000000003", "RiskScore": float("nan")})
    valid = silver.silver_split("transactions", transactions).valid
    checked = gold.fact_transactions(valid, silver.silver_split("transaction_risk", risk, valid).valid)
    ranged = gold.fact_transactions(valid, risk.where(F.coalesce(rules.score_in_range(), F.lit(False))))
    assert sorted(map(str, checked.collect())) == sorted(map(str, ranged.collect()))


def test_missing_keys_share_one_hash(rows):
    fact = gold.fact_digital_sessions(silver.silver_split("sessions", rows("digitalSessions", {"device": "{}"})).valid)
    assert fact.first()["DeviceSK"] == 42
    assert len(fact.columns) == 18


@pytest.fixture
def driver_zone(monkeypatch):
    def set_to(zone):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
    yield set_to
    monkeypatch.undo()
    time.tzset()


@pytest.mark.parametrize("zone", ["America/New_York", "Pacific/Kiritimati"])
def test_stored_profile_does_not_depend_on_the_drivers_zone(spark, driver_zone, zone):
    from tallyweir.queries import QUERIES

    content = lambda name: sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    expected = content("j05_risk_profile")
    driver_zone(zone)
    assert content("j05_risk_profile_stored") == expected
