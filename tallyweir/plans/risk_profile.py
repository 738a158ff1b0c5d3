"""One row per customer any source names, across both sources.

Each source contributes summable measures per customer; the contributions are stacked and added up
in one aggregation. Against an outer join per metric this scans every fact once, shuffles once on
the customer, and folds a busy customer map-side before anything moves. The stack is also the list
of customers: it holds either every row, those outside a window contributing nothing, or the stored
customer dimension beside the rows inside the windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir import model
from tallyweir.functions.scoring import customer_risk_band, customer_risk_score
from tallyweir.operators.customer_metrics import device_signals, device_usage, flag_usage
from tallyweir.operators.windows import (
    WINDOW_DAYS, in_trailing_window, trailing_window, window_start,
)

COUNTS = (
    "TransactionCount30D", "HighRiskTransactionCount", "FraudAlertCount", "FailedLoginCount",
    "DistinctDeviceCount", "UntrustedDeviceCount", "GeographicAnomalyCount",
)
# Summed beside the published measures, for the average.
SCORE_TOTAL = "_score_total"
SCORED = "_scored"

PROFILE_COLUMNS = (
    "CustomerID", "TransactionCount30D", "TotalTransactionAmount30D",
    "AverageTransactionRiskScore", "HighRiskTransactionCount", "FraudAlertCount",
    "FailedLoginCount", "DistinctDeviceCount", "UntrustedDeviceCount", "GeographicAnomalyCount",
    "CustomerRiskScore", "CustomerRiskBand",
)


def _contribution(df: DataFrame, **measures: Column) -> DataFrame:
    """(CustomerID, the measures this source knows); a condition counts as 0 or 1."""
    return df.select("CustomerID", *(value.alias(name) for name, value in measures.items()))


def _counted(condition: Column) -> Column:
    return condition.cast("bigint")


def _transaction_measures(transactions: DataFrame, recent: Column) -> DataFrame:
    score = F.when(recent, F.col("RiskScore"))
    elevated = F.col("RiskBand").isin(*model.ELEVATED_BANDS)
    return _contribution(
        transactions,
        TransactionCount30D=_counted(recent),
        TotalTransactionAmount30D=F.when(recent, F.col("Amount")),
        HighRiskTransactionCount=_counted(recent & elevated),
        **{SCORE_TOTAL: score, SCORED: _counted(score.isNotNull())},
    )


def _all_rows(
    transactions: DataFrame, sessions: DataFrame, alerts: DataFrame, devices: DataFrame,
    transactions_start: Column, sessions_start: Column, days: int,
) -> tuple[DataFrame, ...]:
    """Contributions of every row; those outside a window still name their customer."""
    # The window test is a column of its own, so it is evaluated once per row.
    recent = F.col("_recent")
    transactions = transactions.withColumn(
        "_recent", in_trailing_window("TransactionTimestamp", transactions_start, days)
    )
    sessions = sessions.withColumn(
        "_recent", in_trailing_window("LoginTimestamp", sessions_start, days)
    )
    alert_is_recent = in_trailing_window("AlertTimestamp", sessions_start, days)
    return (
        _transaction_measures(transactions, recent),
        _contribution(alerts, FraudAlertCount=_counted(alert_is_recent)),
        device_signals(flag_usage(device_usage(sessions, recent), devices)),
        devices.select(F.col("customerId").alias("CustomerID")),
    )


def _recent_rows(
    transactions: DataFrame, sessions: DataFrame, alerts: DataFrame, devices: DataFrame,
    transactions_start: Column, sessions_start: Column, days: int, customers: DataFrame,
) -> tuple[DataFrame, ...]:
    """Contributions of the rows inside the windows, beside a given list of all customers."""
    recent = trailing_window(transactions, "TransactionTimestamp", transactions_start, days)
    used = trailing_window(sessions, "LoginTimestamp", sessions_start, days)
    alerted = trailing_window(alerts, "AlertTimestamp", sessions_start, days)
    return (
        customers.select("CustomerID"),
        _transaction_measures(recent, F.lit(True)),
        _contribution(alerted, FraudAlertCount=_counted(F.lit(True))),
        device_signals(flag_usage(device_usage(used), devices)),
    )


def scored_profile(metrics: DataFrame) -> DataFrame:
    """P10, P11 on top of the metrics, in published column order."""
    return (
        metrics.withColumn("CustomerRiskScore", customer_risk_score())
        .withColumn("CustomerRiskBand", customer_risk_band())
        .select(*PROFILE_COLUMNS)
    )


def customer_risk_profile(
    fact_transactions: DataFrame,
    fact_sessions: DataFrame,
    fact_alerts: DataFrame,
    devices: DataFrame,
    transactions_start: Column | None = None,
    sessions_start: Column | None = None,
    days: int = WINDOW_DAYS,
    customers: DataFrame | None = None,
) -> DataFrame:
    """The cross-source profile. Each source is windowed by its own last day (T02); alerts follow the
    sessions' clock, like every measure of the document source.

    Counts without rows are 0 and a missing or NaN amount is 0.0 (F15); the average score of a
    customer without scores stays NULL.

    With ``customers``, the stored list of all of them, only rows inside the windows are read.
    Without it every row is, since any of them may name a customer.
    """
    if transactions_start is None:
        transactions_start = window_start(fact_transactions, "TransactionTimestamp", days)
    if sessions_start is None:
        sessions_start = window_start(fact_sessions, "LoginTimestamp", days)
    given = (
        fact_transactions, fact_sessions, fact_alerts, devices, transactions_start, sessions_start, days,
    )
    return profile_of(_all_rows(*given) if customers is None else _recent_rows(*given, customers))


def profile_of(parts: Sequence[DataFrame]) -> DataFrame:
    """The profile from its sources' contributions: stacked, added up by customer, scored."""
    stacked = reduce(
        lambda stack, more: stack.unionByName(more, allowMissingColumns=True), parts
    ).where(F.col("CustomerID").isNotNull())
    summed = (*COUNTS, "TotalTransactionAmount30D", SCORED, SCORE_TOTAL)
    totals = stacked.groupBy("CustomerID").agg(*(F.sum(name).alias(name) for name in summed))
    average = F.when(F.col(SCORED) > 0, F.col(SCORE_TOTAL) / F.col(SCORED))
    return scored_profile(
        totals.withColumn("AverageTransactionRiskScore", average)
        .fillna(0, [*COUNTS, "TotalTransactionAmount30D"])
    )
