"""Data contracts: source, derived and audit tables.

Column names, accepted values, formats and limits below are fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType, "double": T.DoubleType, "boolean": T.BooleanType, "int": T.IntegerType,
    "bigint": T.LongType, "timestamp": T.TimestampType,
}


def _ddl(text: str) -> T.StructType:
    """``name type, ...`` as a schema; ``StructType.fromDDL`` would need a running session at import."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in pairs])


# --- source tables ----------------------------------------------------------------------------

TRANSACTIONS = _ddl("""
    TransactionID string, AccountID string, CustomerID string, MerchantID string,
    TransactionTimestamp timestamp, Amount double, Currency string, TransactionType string,
    MerchantCategory string, Channel string, Country string, DeviceID string,
    CardPresent boolean, TransactionStatus string
""")
RISK_SCORES = _ddl("""
    TransactionID string, RiskScore double, RiskBand string, ModelVersion string,
    ScoredTimestamp timestamp, RiskFactors string
""")
MERCHANTS = _ddl("""
    MerchantID string, MerchantName string, MerchantCategory string, City string, State string,
    Country string, MerchantRiskCategory string
""")

# Nested objects and arrays of a document are kept as JSON text; an absent property reads as NULL.
DOCUMENTS = {
    "digitalSessions": _ddl("""
        id string, sessionId string, customerId string, device string, loginTimestamp string,
        logoutTimestamp string, ipAddress string, geo string, authentication string,
        activities string, sessionRiskScore int, synthetic boolean, changeType string
    """),
    "devices": _ddl("""
        id string, deviceId string, customerId string, firstSeen string, lastSeen string,
        trusted boolean, deviceFingerprint string, operatingSystem string, appVersion string,
        riskSignals string, geoHistory string, synthetic boolean, changeType string
    """),
    "fraudAlerts": _ddl("""
        id string, alertId string, customerId string, transactionId string,
        createdTimestamp string, alertType string, severity string, status string,
        signals string, investigatorNotes string, resolution string, synthetic boolean,
        changeType string
    """),
}

DOCUMENT_KEY = ("customerId", "id")

# Present on every document of the container.
REQUIRED_FIELDS = {
    "digitalSessions": (
        "id", "sessionId", "customerId", "device", "loginTimestamp", "logoutTimestamp",
        "ipAddress", "geo", "authentication", "activities", "sessionRiskScore",
    ),
    "devices": (
        "id", "deviceId", "customerId", "firstSeen", "lastSeen", "trusted",
        "deviceFingerprint", "operatingSystem", "appVersion", "riskSignals",
    ),
    "fraudAlerts": (
        "id", "alertId", "customerId", "transactionId", "createdTimestamp", "alertType",
        "severity", "status", "signals", "investigatorNotes",
    ),
}
# Present on some documents of the container, absent on others.
OPTIONAL_FIELD = {"devices": "geoHistory", "fraudAlerts": "resolution"}

# --- accepted values --------------------------------------------------------------------------

RISK_BANDS = ("Low", "Medium", "High", "Critical")
ELEVATED_BANDS = ("High", "Critical")
SEVERITIES = ("low", "medium", "high", "critical")
AMOUNT_CEILING = 1_000_000
KEY_PREFIXES = {
    "TransactionID": "TXN-",
    "CustomerID": "CUST-",
    "AccountID": "ACCT",
    "DeviceID": "DEV-",
    "MerchantID": "MER",
}
# \A and \z rather than ^ and $: a trailing newline must not slip through.
TRANSACTION_ID_PATTERN = r"\ATXN-\d{9}\z"
CUSTOMER_ID_PATTERN = r"\ACUST-\d{6}\z"
DEVICE_ID_PATTERN = r"\ADEV-\d{6}\z"

# --- layers -----------------------------------------------------------------------------------

TABLE_SOURCES = ("transactions", "transaction_risk_scores", "merchants")
DOCUMENT_SOURCES = ("digitalSessions", "devices", "fraudAlerts")

# Silver table -> the source it is built from.
SILVER_SOURCE = {
    "transactions": "transactions",
    "transaction_risk": "transaction_risk_scores",
    "merchants": "merchants",
    "sessions": "digitalSessions",
    "devices": "devices",
    "fraud_alerts": "fraudAlerts",
}
SILVER_TABLES = tuple(SILVER_SOURCE)
QUARANTINE_TABLES = tuple(f"quarantine_{name}" for name in SILVER_TABLES)
GOLD_TABLES = (
    "dimcustomer", "dimaccount", "dimmerchant", "dimdevice", "dimdate",
    "facttransactions", "factdigitalsessions", "factfraudalerts", "aggcustomerriskprofile",
)
LOAD_STAMP = "_gold_loaded_at"

# --- audit ------------------------------------------------------------------------------------

RUN_STATUSES = ("Succeeded", "Failed")
RUN_LOG = _ddl("""
    run_id string, stage string, status string, start_ts timestamp, end_ts timestamp,
    rows_read bigint, rows_written bigint, error_message string, run_date string
""")
RECONCILIATION = _ddl("""
    source string, object string, source_count bigint, target_count bigint,
    validation_type string, status string, notes string, run_id string, run_date string
""")
