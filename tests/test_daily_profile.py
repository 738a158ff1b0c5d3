"""The profile kept up to date by days, against the profile of all facts."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweir import queries
from tallyweir.plans import daily_profile
from tallyweir.plans.daily_profile import DailyProfile
from tallyweir.plans.risk_profile import customer_risk_profile

FACTS = {
    "transactions": "CustomerID string, TransactionTimestamp timestamp, Amount double, RiskScore double, RiskBand string",
    "sessions": "CustomerID string, LoginTimestamp timestamp, DeviceID string, GeoCountry string, AuthFailedAttempts int",
    "alerts": "CustomerID string, AlertTimestamp timestamp",
}
DEVICES = "deviceId string, customerId string, trusted boolean, geoHistory string"
START = datetime(2026, 1, 1)


def rows_of_days(rng, first, last, count):
    """Random rows of the facts on the days from ``first`` to ``last``, some without a moment."""
    def moment():
        return None if rng.random() < 0.03 else START + timedelta(days=rng.uniform(first, last + 0.99))

    def customer():
        return f"C{min(rng.randint(0, 12), rng.randint(0, 12))}"

    amounts = [0.1, 0.2, 10.25, None, 99.99, 1e9]
    return {
        "transactions": [(customer(), moment(), rng.choice(amounts), rng.choice([None, 7.31, 55.5, 90.07]), rng.choice(["Low", "High", None])) for _ in range(count)],
        "sessions": [(customer(), moment(), rng.choice([None, "D1", "D2", "D3", "D4"]), rng.choice([None, "US", "GB"]), rng.choice([None, 0, 0, 2])) for _ in range(count)],
        "alerts": [(customer(), moment()) for _ in range(count // 3)],
    }


def told(df):
    out = {}
    for r in df.collect():
        values = r.asDict()
        for name, digits in (("TotalTransactionAmount30D", 4), ("AverageTransactionRiskScore", 8)):
            value = values[name]
            values[name] = value if value is None or math.isinf(value) else round(value, digits)
        out[r["CustomerID"]] = values
    return out


@pytest.fixture
def devices(frame):
    return frame(DEVICES, ("D1", "C1", True, '[{"country":"US"}]'), ("D2", "C2", False, None), ("D3", "C3", None, '[{"country":"GB"}]'), ("D4", "C99", False, "[]"))


@pytest.fixture
def frames(frame):
    return lambda rows: [frame(FACTS[name], *rows[name]) for name in FACTS]


def test_every_batch_equals_the_profile_of_all_rows(lake, frames, devices):
    rng = random.Random(1)
    kept = DailyProfile(lake, days=7)
    every = {name: [] for name in FACTS}
    # New days, a jump past the whole window, late rows, days of the window again, nothing, alerts ahead of the sessions.
    for batch, (first, last, count) in enumerate(((0, 9, 80), (8, 12, 30), (40, 43, 30), (1, 41, 60), (44, 46, 20), (0, 0, 0), (47, 47, 6))):
        rows = rows_of_days(rng, first, last, count)
        if batch == 4:
            rows["alerts"] += [("C1", START + timedelta(days=47.5)), ("C77", START + timedelta(days=47.6))]
        for name in FACTS:
            every[name] += rows[name]
        state = kept.advance(*frames(rows))
        assert state.batch == batch + 1
        whole = customer_risk_profile(*frames(every), devices, days=7)
        assert told(kept.profile(devices)) == told(whole)


def test_taking_off_days_leaves_no_trace_of_them(lake, frames, devices):
    day = lambda n: START + timedelta(days=n)
    kept = DailyProfile(lake, days=2)
    nan, inf = float("nan"), float("inf")
    kept.advance(*frames({"transactions": [("A", day(0), nan, 1.1, "High"), ("B", day(0), inf, 2.2, None), ("A", day(0), 0.1, None, "Low"), ("A", day(1), 0.2, 3.3, "Low")],
                          "sessions": [("A", day(0), "D2", "US", 1), ("A", day(1), "D2", "US", 0)], "alerts": [("B", day(0))]}))
    first = told(kept.profile(devices))
    assert first["A"]["TotalTransactionAmount30D"] == 0.0 and math.isinf(first["B"]["TotalTransactionAmount30D"])
    assert first["A"]["FailedLoginCount"] == 1 and first["A"]["DistinctDeviceCount"] == 1
    kept.advance(*frames({"transactions": [("A", day(2), 0.3, None, None)], "sessions": [("C", day(2), None, None, None)], "alerts": []}))
    second = told(kept.profile(devices))
    assert second["A"]["TotalTransactionAmount30D"] == 0.5 and second["A"]["FailedLoginCount"] == 0 and second["A"]["UntrustedDeviceCount"] == 1
    assert second["B"]["TransactionCount30D"] == 0 and second["B"]["FraudAlertCount"] == 0 and second["B"]["CustomerRiskBand"] == "Low"


def test_a_lost_advance_is_repeated_with_the_same_result(lake, frames, devices, monkeypatch):
    rng = random.Random(2)
    kept = DailyProfile(lake, days=7)
    one, two = rows_of_days(rng, 0, 9, 40), rows_of_days(rng, 9, 14, 40)
    kept.advance(*frames(one))
    before = told(kept.profile(devices))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(daily_profile, "overwrite", lost)
    with pytest.raises(RuntimeError):
        kept.advance(*frames({name: two[name] * 2 for name in two}))
    monkeypatch.undo()
    assert told(kept.profile(devices)) == before and kept.state().batch == 1
    kept.advance(*frames(two))
    every = {name: one[name] + two[name] for name in FACTS}
    assert told(kept.profile(devices)) == told(customer_risk_profile(*frames(every), devices, days=7))


def test_only_days_on_which_the_windows_differ_are_read(lake, frames):
    kept = DailyProfile(lake, days=30)
    rng = random.Random(3)
    kept.advance(*frames(rows_of_days(rng, 0, 59, 200)))
    before = kept.state().window(daily_profile.TRANSACTIONS)
    after = (before[0] + 1, before[1] + 1)
    log = kept._log("measures", daily_profile.MEASURES, "CustomerID", "clock")
    lost = log.where((F.col("_batch") < 2) & daily_profile._differs(before, after))
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "_span#" in plan.split("PartitionFilters: [")[1].split("DataFilters")[0]
    assert {r[0] for r in lost.select("day").distinct().collect()} == {before[0]}
    assert len(lost.inputFiles()) >= 1 and lost.rdd.getNumPartitions() <= 2


def test_state_keeps_its_window_length(lake, frames):
    empty = {name: [] for name in FACTS}
    assert DailyProfile(lake, days=7).advance(*frames(empty)) [:4] == (1, 7, None, None)
    with pytest.raises(ValueError, match="windows of 7 days"):
        DailyProfile(lake, days=8).advance(*frames(empty))


def test_the_query_builds_each_fact_once(spark, monkeypatch):
    built = []
    overwrite = queries.sinks.overwrite
    monkeypatch.setattr(queries.sinks, "overwrite", lambda lake, df, name: (built.append(name), overwrite(lake, df, name))[1])
    taken, advance = [], queries.DailyProfile.advance
    monkeypatch.setattr(queries.DailyProfile, "advance", lambda self, *facts: (taken.extend(facts), advance(self, *facts))[1])
    queries.QUERIES["j05_risk_profile_daily"](spark, "/root/testdata/sf0.001")
    assert sorted(built) == ["arrived_AlertID", "arrived_SessionID", "arrived_TransactionID"] and len(taken) == 9
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in taken)
