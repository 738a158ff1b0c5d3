"""The business queries on Gold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tallyweir.operators.counts import table_inventory
from tallyweir.sinks.tables import Lake, write_result

TOP_RISK_COLUMNS = (
    "CustomerSK", "CustomerID", "CustomerRiskScore", "CustomerRiskBand", "TransactionCount30D",
    "TotalTransactionAmount30D", "AverageTransactionRiskScore", "FraudAlertCount",
    "FailedLoginCount", "UntrustedDeviceCount", "GeographicAnomalyCount",
)


def top_risk_customers(profile: DataFrame, customers: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` highest scores; equal scores in order of the customer id.

    The limit comes before the display join, which then looks up ``n`` rows. Both sides have one
    row per customer and the profile's customers are the dimension's, so the result is the same.
    """
    ranked = profile.orderBy(F.col("CustomerRiskScore").desc(), F.col("CustomerID")).limit(n)
    return (
        customers.join(F.broadcast(ranked), "CustomerID")
        .orderBy(F.col("CustomerRiskScore").desc(), F.col("CustomerID"))
        .select(*TOP_RISK_COLUMNS)
    )


def fraud_investigation(alerts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Alerts beside the transaction they refer to, where both name the same customer.

    Only alerts that refer to a transaction travel; an inner join, so AQE may split a transaction
    that very many alerts refer to, on either side.
    """
    referring = alerts.where(F.col("TransactionID").isNotNull()).select(
        "AlertID", "CustomerID", "Severity", "AlertType", "AlertTimestamp", "TransactionID",
        "CustomerSK",
    )
    details = transactions.select(
        "TransactionID", "CustomerSK", "Amount", "TransactionType", "Channel",
        "TransactionTimestamp", "RiskScore", "RiskBand",
    )
    return referring.join(details, ["TransactionID", "CustomerSK"]).select(
        "AlertID", "CustomerID", "Severity", "AlertType", "AlertTimestamp", "TransactionID",
        "Amount", "TransactionType", "Channel", "TransactionTimestamp", "RiskScore", "RiskBand",
    )


def failed_checks(reconciliation: DataFrame) -> DataFrame:
    """I05."""
    return reconciliation.where(F.col("status") == "FAIL")


def write_consumption(
    lake: Lake, silver: dict[str, DataFrame], gold: dict[str, DataFrame], run_at: datetime
) -> dict[str, int]:
    """The three consumption tables of a run, sharing one stamp."""
    results = {
        "demo_table_inventory": table_inventory({"silver": silver, "gold": gold}),
        "demo_top_risk_customers": top_risk_customers(
            gold["aggcustomerriskprofile"], gold["dimcustomer"]
        ),
        "demo_fraud_investigation": fraud_investigation(
            gold["factfraudalerts"], gold["facttransactions"]
        ),
    }
    return {table: write_result(lake, df, table, run_at) for table, df in results.items()}
