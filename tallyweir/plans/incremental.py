"""The deterministic incremental batches and how they are applied."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from tallyweir import model
from tallyweir.operators.merge import merge_insert_missing, merge_update_matched, upsert_documents
from tallyweir.sources.documents import document_schema
from tallyweir.sources.tables import ordinals, rows_frame

# Fixed values of the batches.
CUSTOMERS = 50_000
MERCHANT_POPULATION = 1_500
AMOUNT_STEPS = 249_900
NEW_TRANSACTION = {
    "Currency": "USD", "TransactionType": "Purchase", "MerchantCategory": "Digital Goods",
    "Channel": "Mobile", "Country": "US", "CardPresent": False, "TransactionStatus": "Approved",
}
NEW_SCORE = {
    "RiskScore": 72.5, "RiskBand": "High", "ModelVersion": "synthetic-risk-v1",
    "RiskFactors": "velocity,new_account",
}
CHANGED_SCORES = (
    ("TXN-000000001", 91.25, "Critical", "synthetic-risk-v2", "controlled_score_change"),
    ("TXN-000000002", 88.00, "Critical", "synthetic-risk-v2", "controlled_score_change"),
)
NEW_MERCHANT = (
    "MER001501", "Synthetic Incremental Merchant Co", "Digital Goods", "Springfield", "IL", "US",
    "Medium",
)


def _utc(as_of: datetime) -> datetime:
    """A naive moment would mean the driver's zone to one reader and UTC to another."""
    if as_of.tzinfo is None:
        raise ValueError("as_of needs a time zone")
    return as_of.astimezone(timezone.utc)


def _drawn(what: str, out_of: int):
    """Deterministic number in [0, out_of) for a row's ordinal."""
    return F.pmod(F.xxhash64(F.lit(what), "Ordinal"), F.lit(out_of))


class TransactionBatch(NamedTuple):
    transactions: DataFrame
    scores: DataFrame


def incremental_transactions(
    spark: SparkSession, base: int, count: int, as_of: datetime
) -> TransactionBatch:
    """``count`` new transactions after the first ``base``, with a score each.

    ``as_of`` stamps them; given the same arguments the batch is the same, so merging it again
    changes nothing.
    """
    if base < 1 or count < 1:
        raise ValueError("base and count must be positive")
    moment = F.lit(_utc(as_of)).cast("timestamp")
    customer = _drawn("customer", CUSTOMERS) + 1
    columns = {
        "TransactionID": F.format_string("TXN-%09d", F.col("Ordinal") + 1),
        "AccountID": F.format_string("ACCT%09d", customer * 2 - _drawn("account", 2)),
        "CustomerID": F.format_string("CUST-%06d", customer),
        "MerchantID": F.format_string("MER%06d", _drawn("merchant", MERCHANT_POPULATION) + 1),
        "TransactionTimestamp": moment,
        "Amount": (_drawn("amount", AMOUNT_STEPS) + 100).cast("double") / 100,
        "DeviceID": F.format_string("DEV-%06d", customer * 3 - _drawn("device", 3)),
        **{name: F.lit(value) for name, value in NEW_TRANSACTION.items()},
    }
    transactions = ordinals(spark, base, count).select(
        *(columns[name].alias(name) for name in model.TRANSACTIONS.names)
    )
    score = {"TransactionID": F.col("TransactionID"), "ScoredTimestamp": moment,
             **{name: F.lit(value) for name, value in NEW_SCORE.items()}}
    scores = transactions.select(*(score[name].alias(name) for name in model.RISK_SCORES.names))
    return TransactionBatch(transactions, scores)


class ChangeBatch(NamedTuple):
    scores: DataFrame
    merchants: DataFrame


def incremental_changes(spark: SparkSession, as_of: datetime) -> ChangeBatch:
    """Two changed scores and one new merchant."""
    names = ("TransactionID", "RiskScore", "RiskBand", "ModelVersion", "RiskFactors")
    schema = StructType([StructField(name, model.RISK_SCORES[name].dataType) for name in names])
    scores = rows_frame(spark, CHANGED_SCORES, schema).withColumn(
        "ScoredTimestamp", F.lit(_utc(as_of)).cast("timestamp")
    )
    return ChangeBatch(
        scores.select(*model.RISK_SCORES.names), rows_frame(spark, [NEW_MERCHANT], model.MERCHANTS)
    )


def apply_table_batches(
    tables: Mapping[str, DataFrame], new: TransactionBatch, changes: ChangeBatch
) -> dict[str, DataFrame]:
    """M04 and M05 merged into the three source tables, as new frames."""
    scores = merge_insert_missing(tables["transaction_risk_scores"], new.scores, "TransactionID")
    return {
        "transactions": merge_insert_missing(
            tables["transactions"], new.transactions, "TransactionID"
        ),
        "transaction_risk_scores": merge_update_matched(scores, changes.scores, "TransactionID"),
        "merchants": merge_insert_missing(tables["merchants"], changes.merchants, "MerchantID"),
    }


def document_batch(spark: SparkSession, as_of: datetime) -> dict[str, DataFrame]:
    """A new session, a device that lost trust, a new alert and a changed one, tagged by change."""
    anchor = _utc(as_of)

    def iso(shift: timedelta = timedelta()) -> str:
        return (anchor + shift).strftime("%Y-%m-%dT%H:%M:%S.") + f"{anchor.microsecond // 1000:03d}Z"

    # Fixed values; properties a document omits stay NULL.
    documents = {
        "digitalSessions": [{
            "id": "SESSION-INC-000001", "sessionId": "SESSION-INC-000001",
            "customerId": "CUST-000001",
            "device": '{"deviceId":"DEV-000001","deviceType":"Mobile","operatingSystem":"iOS 18.3",'
                      '"appVersion":"9.1.1"}',
            "loginTimestamp": iso(), "logoutTimestamp": iso(timedelta(minutes=9)),
            "ipAddress": "203.0.113.77",
            "geo": '{"country":"GB","state":"ENG","city":"London"}',
            "authentication": '{"method":"password+mfa","mfaUsed":true,"failedAttempts":2}',
            "activities": f'[{{"activityType":"login","timestamp":"{iso()}"}}]',
            "sessionRiskScore": 88, "synthetic": True, "changeType": "insert",
        }],
        "devices": [{
            "id": "DEV-000001", "deviceId": "DEV-000001", "customerId": "CUST-000001",
            "firstSeen": iso(-timedelta(days=400)), "lastSeen": iso(), "trusted": False,
            "deviceFingerprint": "SYNTH-FP-INCREMENTAL0", "operatingSystem": "iOS 18.3",
            "appVersion": "9.1.1", "riskSignals": '["impossible_travel"]',
            "geoHistory": '[{"country":"GB","state":"ENG","city":"London",'
                          f'"timestamp":"{iso()}"}}]',
            "synthetic": True, "changeType": "update",
        }],
        "fraudAlerts": [
            {
                "id": "ALERT-INC-000001", "alertId": "ALERT-INC-000001",
                "customerId": "CUST-000001", "transactionId": "TXN-000000001",
                "createdTimestamp": iso(), "alertType": "accountTakeover", "severity": "critical",
                "status": "open", "signals": '["geoImpossibleTravel","deviceMismatch"]',
                "investigatorNotes": "[]", "synthetic": True, "changeType": "insert",
            },
            {
                "id": "ALERT-00000001", "alertId": "ALERT-00000001", "customerId": "CUST-000001",
                "transactionId": "TXN-000000002", "createdTimestamp": iso(-timedelta(hours=6)),
                "alertType": "transactionAnomaly", "severity": "high", "status": "investigating",
                "signals": '["velocityAnomaly"]',
                "investigatorNotes": '["Escalated after the new device-mismatch alert on this customer."]',
                "synthetic": True, "changeType": "update",
            },
        ],
    }
    return {
        container: rows_frame(
            spark,
            [tuple(row.get(name) for name in document_schema(container).names) for row in rows],
            document_schema(container),
        )
        for container, rows in documents.items()
    }


def apply_document_batch(
    containers: Mapping[str, DataFrame], batch: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """M06 upserted into the three containers, as new frames."""
    return {
        name: upsert_documents(target, batch[name]) if name in batch else target
        for name, target in containers.items()
    }
