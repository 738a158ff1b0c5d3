"""Gold: star schema keyed by business-key hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir.functions.keys import date_key, surrogate_key
from tallyweir.operators.months import recent_before
from tallyweir.operators.skew import heavy_keys, left_fanout
from tallyweir.operators.windows import start_before
from tallyweir.plans.risk_profile import customer_risk_profile
from tallyweir.sinks.tables import Lake, side_by_side, write_gold, write_gold_by_month
from tallyweir.sources.calendar import dim_date

# Silver tables that name a customer.
CUSTOMER_SOURCES = ("transactions", "sessions", "devices", "fraud_alerts")

# Published column -> Silver column.
DEVICE_COLUMNS = {
    "DeviceID": "deviceId", "CustomerID": "customerId", "OS": "operatingSystem",
    "DeviceFingerprint": "deviceFingerprint", "IsTrusted": "trusted",
}
SESSION_COLUMNS = {
    "SessionID": "sessionId", "CustomerID": "customerId", "DeviceID": "device_deviceId",
    "LoginTimestamp": "loginTimestamp", "LogoutTimestamp": "logoutTimestamp",
    "DeviceType": "device_deviceType", "DeviceOS": "device_operatingSystem",
    "GeoCountry": "geo_country", "GeoState": "geo_state", "GeoCity": "geo_city",
    "GeoIpAddress": "ipAddress", "AuthMethod": "auth_method", "AuthMfaUsed": "auth_mfaUsed",
    "AuthFailedAttempts": "auth_failedAttempts", "ActivitiesJson": "activities",
}
ALERT_COLUMNS = {
    "AlertID": "alertId", "CustomerID": "customerId", "TransactionID": "transactionId",
    "AlertTimestamp": "createdTimestamp", "Severity": "severity", "AlertType": "alertType",
}
MERCHANT_COLUMNS = (
    "MerchantID", "MerchantName", "MerchantCategory", "City", "State", "Country",
    "MerchantRiskCategory",
)
TRANSACTION_MEASURES = (
    "TransactionTimestamp", "Amount", "Currency", "TransactionType", "Channel", "Country",
    "DeviceID", "CardPresent", "TransactionStatus",
)


# What a fact's rows are windowed by.
FACT_MOMENTS = {
    "facttransactions": "TransactionTimestamp",
    "factdigitalsessions": "LoginTimestamp",
    "factfraudalerts": "AlertTimestamp",
}


def _published(columns: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.col(source).alias(name) for name, source in columns.items()}


def _key(name: str, source: str) -> Column:
    return surrogate_key(source).alias(name)


def customer_spine(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Every customer any source names, once."""
    named = (
        silver[table].select(F.col("customerId").alias("CustomerID")) for table in CUSTOMER_SOURCES
    )
    return reduce(DataFrame.unionByName, named).where(F.col("CustomerID").isNotNull()).distinct()


def dim_customer(silver: Mapping[str, DataFrame]) -> DataFrame:
    return customer_spine(silver).select(_key("CustomerSK", "CustomerID"), "CustomerID")


def dim_account(transactions: DataFrame) -> DataFrame:
    """One row per (account, customer) pair; an account under two customers appears twice."""
    return transactions.select("AccountID", "CustomerID").distinct().select(
        _key("AccountSK", "AccountID"), "AccountID", "CustomerID", _key("CustomerSK", "CustomerID")
    )


def dim_merchant(merchants: DataFrame) -> DataFrame:
    """One row per Silver row."""
    return merchants.select(_key("MerchantSK", "MerchantID"), *MERCHANT_COLUMNS)


def dim_device(devices: DataFrame) -> DataFrame:
    """One row per Silver row."""
    own = _published(DEVICE_COLUMNS)
    return devices.select(
        _key("DeviceSK", "deviceId"), own["DeviceID"], own["CustomerID"],
        _key("CustomerSK", "customerId"), own["OS"], own["DeviceFingerprint"], own["IsTrusted"],
    )


def fact_transactions(
    transactions: DataFrame, risk: DataFrame, heavy: Sequence | None = None
) -> DataFrame:
    """Every valid transaction with its scores; one without a valid score keeps NULLs.

    A transaction scored twice yields two rows. Since the join itself only lets scores of valid
    transactions through, ``risk`` may also be the scores that are merely in range: the membership
    join of J01 is not needed to build the fact.
    """
    scores = risk.select("TransactionID", "RiskScore", "RiskBand")
    if heavy is None:
        heavy = heavy_keys(scores, "TransactionID")
    return left_fanout(transactions, scores, "TransactionID", heavy).select(
        "TransactionID",
        _key("CustomerSK", "CustomerID"), "CustomerID",
        _key("AccountSK", "AccountID"), _key("MerchantSK", "MerchantID"),
        date_key("TransactionTimestamp").alias("DateKey"),
        *TRANSACTION_MEASURES,
        "RiskScore", "RiskBand",
    )


def fact_digital_sessions(sessions: DataFrame) -> DataFrame:
    """One row per Silver row."""
    own = _published(SESSION_COLUMNS)
    identity = [own.pop(name) for name in ("SessionID", "CustomerID", "DeviceID")]
    return sessions.select(
        identity[0], _key("CustomerSK", "customerId"), *identity[1:],
        _key("DeviceSK", "device_deviceId"), date_key("loginTimestamp").alias("DateKey"),
        *own.values(),
    )


def fact_fraud_alerts(alerts: DataFrame) -> DataFrame:
    """One row per Silver row; status, signals and resolution stay in Silver."""
    own = _published(ALERT_COLUMNS)
    identity = [own.pop(name) for name in ("AlertID", "CustomerID", "TransactionID")]
    return alerts.select(
        identity[0], _key("CustomerSK", "customerId"), *identity[1:],
        date_key("createdTimestamp").alias("DateKey"), *own.values(),
    )


def build_gold(silver: Mapping[str, DataFrame], days: int = 30) -> dict[str, DataFrame]:
    """The nine Gold tables as lazy frames, by name."""
    facts = {
        "facttransactions": fact_transactions(silver["transactions"], silver["transaction_risk"]),
        "factdigitalsessions": fact_digital_sessions(silver["sessions"]),
        "factfraudalerts": fact_fraud_alerts(silver["fraud_alerts"]),
    }
    return {
        "dimcustomer": dim_customer(silver),
        "dimaccount": dim_account(silver["transactions"]),
        "dimmerchant": dim_merchant(silver["merchants"]),
        "dimdevice": dim_device(silver["devices"]),
        "dimdate": dim_date(silver["transactions"].sparkSession),
        **facts,
        "aggcustomerriskprofile": customer_risk_profile(
            *facts.values(), silver["devices"], days=days
        ),
    }


def refresh_gold(
    lake: Lake, silver: Mapping[str, DataFrame], loaded_at: datetime | None = None, days: int = 30
) -> dict[str, int]:
    """Rebuild the nine Gold tables from Silver; returns rows per table.

    A fact is kept by month, its files in time order, so that a window on a stored fact opens the months it
    touches and skips what lies outside. The profile reads the stored facts through such windows, from the
    last days the writes observed, beside the stored customers.
    """
    plans = build_gold(silver, days)
    del plans["aggcustomerriskprofile"]

    def write(name: str) -> dict:
        if name not in FACT_MOMENTS:
            return write_gold(lake, plans[name], name, loaded_at)
        return write_gold_by_month(lake, plans[name], name, FACT_MOMENTS[name], loaded_at)

    written = side_by_side(lake, {name: partial(write, name) for name in plans})
    transactions_last, sessions_last = (written[name]["last"] for name in ("facttransactions", "factdigitalsessions"))

    def recent(name: str, last: int | None) -> DataFrame:
        return recent_before(lake.read(name), FACT_MOMENTS[name], last, days)

    profile = customer_risk_profile(
        recent("facttransactions", transactions_last), recent("factdigitalsessions", sessions_last),
        recent("factfraudalerts", sessions_last), silver["devices"],
        start_before(transactions_last, days), start_before(sessions_last, days),
        days, lake.read("dimcustomer"),
    )
    written["aggcustomerriskprofile"] = write_gold(lake, profile, "aggcustomerriskprofile", loaded_at)
    return {name: result["rows"] for name, result in written.items()}
