"""What makes a row of each Silver table valid.

A rule may evaluate to NULL; the split in ``operators.quality`` counts that as invalid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyweir import model

# Set by the membership lookup of ``plans.silver`` before the score rule is applied.
KNOWN_TRANSACTION = "_known_transaction"


def _present(*columns: str) -> Column:
    return reduce(Column.__and__, (F.col(name).isNotNull() for name in columns))


def transactions() -> Column:
    """F02. NaN amounts pass ``>= 0``, as they do in the data model's own check."""
    return (
        _present("CustomerID", "TransactionTimestamp")
        & F.col("TransactionID").rlike(model.TRANSACTION_ID_PATTERN)
        & (F.col("Amount") >= 0)
    )


def score_in_range() -> Column:
    """The part of F03 a score row can answer alone; NaN is out of range."""
    return F.col("RiskScore").between(0, 100)


def transaction_risk() -> Column:
    """score in range and its transaction passed validation."""
    return score_in_range() & F.col(KNOWN_TRANSACTION)


def merchants() -> Column:
    """F04."""
    return _present("MerchantID", "MerchantCategory")


def sessions() -> Column:
    """F05."""
    return _present("sessionId", "customerId")


def devices() -> Column:
    """F06."""
    return _present("deviceId", "customerId")


def fraud_alerts() -> Column:
    """F07."""
    return _present("alertId", "customerId") & F.col("severity").isin(*model.SEVERITIES)


BY_TABLE = {
    "transactions": transactions,
    "transaction_risk": transaction_risk,
    "merchants": merchants,
    "sessions": sessions,
    "devices": devices,
    "fraud_alerts": fraud_alerts,
}
