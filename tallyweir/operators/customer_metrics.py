"""Per-customer metrics of the risk profile.

Transactions and alerts aggregate directly. All session metrics come out of one pass over the
sessions: ``device_usage`` folds them to (customer, device, country), ``flag_usage`` looks up what is
known about the device, and the counts are sums over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir import model
from tallyweir.operators.skew import spread_lookup

# Only the country of a travel-history entry is compared.
TRAVEL_HISTORY = "array<struct<country:string>>"

_USAGE = ("CustomerID", "DeviceID", "GeoCountry")


def transaction_metrics(fact_transactions: DataFrame) -> DataFrame:
    """A01 over the rows given; apply F08 first. Missing scores do not count in the average."""
    elevated = F.col("RiskBand").isin(*model.ELEVATED_BANDS)
    return fact_transactions.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("TransactionCount30D"),
        F.sum("Amount").alias("TotalTransactionAmount30D"),
        F.avg("RiskScore").alias("AverageTransactionRiskScore"),
        F.count_if(elevated).alias("HighRiskTransactionCount"),
    )


def alert_metrics(fact_fraud_alerts: DataFrame) -> DataFrame:
    """A02 over the rows given; the window is anchored on the sessions' clock."""
    return fact_fraud_alerts.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("FraudAlertCount"))


def device_usage(fact_sessions: DataFrame, in_window: Column | None = None) -> DataFrame:
    """Distinct (customer, device, country) with the sessions that had a failed login.

    With ``in_window``, sessions outside it keep only their customer (device and country NULL, no
    failed login), so the same pass also yields every customer with a session.
    """
    failed = F.coalesce(F.col("AuthFailedAttempts") > 0, F.lit(False))
    columns = [F.col(name) for name in _USAGE]
    if in_window is not None:
        failed = failed & in_window
        columns = [
            F.col("CustomerID"),
            *(F.when(in_window, F.col(name)).alias(name) for name in _USAGE[1:]),
        ]
    return (
        fact_sessions.select(*columns, failed.alias("_failed"))
        .groupBy(*_USAGE)
        .agg(F.count_if("_failed").alias("FailedLogins"))
    )


def device_places(devices: DataFrame) -> DataFrame:
    """Distinct (device, country) pairs of the travel histories; unparsable histories yield none."""
    entries = F.from_json(F.col("geoHistory"), TRAVEL_HISTORY)
    return devices.select(
        F.col("deviceId").alias("DeviceID"), F.explode(entries["country"]).alias("Country")
    ).distinct()


def device_home_countries(devices: DataFrame) -> DataFrame:
    """Device -> set of countries ever recorded. Devices without history have no row."""
    return device_places(devices).groupBy("DeviceID").agg(F.collect_set("Country").alias("HomeCountries"))


def device_facts(devices: DataFrame) -> DataFrame:
    """One row per device: ever marked untrusted (F10), any travel history, the countries in it.

    The countries there are bound the set, however often a device is recorded.
    """
    entries = F.from_json(F.col("geoHistory"), TRAVEL_HISTORY)
    countries = F.array_distinct(F.flatten(F.collect_set(F.array_distinct(entries["country"]))))
    return devices.groupBy(F.col("deviceId").alias("DeviceID")).agg(
        F.coalesce(F.bool_or(~F.col("trusted")), F.lit(False)).alias("IsUntrusted"),
        F.coalesce(F.bool_or(F.size(entries) > 0), F.lit(False)).alias("HasHistory"),
        countries.alias("HomeCountries"),
    )


def flag_usage(usage: DataFrame, devices: DataFrame) -> DataFrame:
    """Usage rows with ``IsUntrusted`` and ``IsAnomaly``.

    An anomaly is a known country outside the history of a device that has one. One left join to one
    row per device that AQE can split: a device may be used by very many customers. Usage without a
    device looks up a key of its own that matches nothing, so that it does not meet in one task.
    """
    nobody = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("CustomerID"), F.lit(4096)).cast("string"))
    keyed = usage.withColumn("_device", F.coalesce("DeviceID", nobody))
    facts = device_facts(devices.where(F.col("deviceId").isNotNull())).withColumnRenamed("DeviceID", "_device")
    found = spread_lookup(keyed, facts, ["_device"], ["CustomerID"])
    at_home = F.coalesce(F.array_contains("HomeCountries", F.col("GeoCountry")), F.lit(False))
    anomaly = F.col("HasHistory") & F.col("GeoCountry").isNotNull() & ~at_home
    return found.select(
        *_USAGE,
        "FailedLogins",
        F.coalesce(F.col("IsUntrusted"), F.lit(False)).alias("IsUntrusted"),
        F.coalesce(anomaly, F.lit(False)).alias("IsAnomaly"),
    )


def device_signals(flagged: DataFrame) -> DataFrame:
    """Per (customer, device): the four session-side metrics as summable counts.

    A device is counted once however many countries it was used in; a NULL device is no device.
    """
    return (
        flagged.groupBy("CustomerID", "DeviceID")
        .agg(
            F.sum("FailedLogins").alias("FailedLoginCount"),
            F.count_if("IsAnomaly").alias("GeographicAnomalyCount"),
            F.bool_or("IsUntrusted").alias("_untrusted"),
        )
        .select(
            "CustomerID",
            "FailedLoginCount",
            F.col("DeviceID").isNotNull().cast("bigint").alias("DistinctDeviceCount"),
            F.col("_untrusted").cast("bigint").alias("UntrustedDeviceCount"),
            "GeographicAnomalyCount",
        )
    )


def session_metrics(fact_sessions: DataFrame) -> DataFrame:
    """Sessions with a failed login, and distinct devices."""
    per_device = device_usage(fact_sessions).groupBy("CustomerID", "DeviceID").agg(
        F.sum("FailedLogins").alias("FailedLogins")
    )
    return per_device.groupBy("CustomerID").agg(
        F.sum("FailedLogins").alias("FailedLoginCount"),
        F.count("DeviceID").alias("DistinctDeviceCount"),
    )


def untrusted_device_counts(fact_sessions: DataFrame, devices: DataFrame) -> DataFrame:
    """Customers with untrusted devices in the rows given, and how many."""
    signals = device_signals(flag_usage(device_usage(fact_sessions), devices))
    return (
        signals.groupBy("CustomerID")
        .agg(F.sum("UntrustedDeviceCount").alias("UntrustedDeviceCount"))
        .where(F.col("UntrustedDeviceCount") > 0)
    )


def geographic_anomaly_counts(fact_sessions: DataFrame, devices: DataFrame) -> DataFrame:
    """Customers with sessions outside the device's travel history, and how many (device, country)."""
    signals = device_signals(flag_usage(device_usage(fact_sessions), devices))
    return (
        signals.groupBy("CustomerID")
        .agg(F.sum("GeographicAnomalyCount").alias("GeographicAnomalyCount"))
        .where(F.col("GeographicAnomalyCount") > 0)
    )
