"""The demo data as Silver and Gold frames, built lazily for the registered queries."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from tallyweir.functions import rules
from tallyweir.operators.quality import Split, fail_closed
from tallyweir.operators.windows import trailing_window, window_start
from tallyweir.plans import gold, silver
from tallyweir.plans.risk_profile import customer_risk_profile
from tallyweir.session import shared_folder
from tallyweir.sinks.tables import Lake, open_lake
from tallyweir.sources.bindings import bind
from tallyweir.sources.calendar import dim_date


class Frames:
    """Each property plans only what it needs; nothing runs before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.sources = bind(spark, sf_dir)

    def driver(self, table: str) -> DataFrame:
        return self.sources.driver(table)

    @cached_property
    def transactions(self) -> Split:
        return silver.silver_split("transactions", self.sources.transactions)

    @cached_property
    def risk(self) -> Split:
        return silver.silver_split(
            "transaction_risk", self.sources.transaction_risk_scores, self.transactions.valid
        )

    @cached_property
    def merchants(self) -> Split:
        return silver.silver_split("merchants", self.sources.merchants)

    @cached_property
    def sessions(self) -> Split:
        return silver.silver_split("sessions", self.sources.digital_sessions)

    @cached_property
    def devices(self) -> Split:
        return silver.silver_split("devices", self.sources.devices)

    @cached_property
    def fraud_alerts(self) -> Split:
        return silver.silver_split("fraud_alerts", self.sources.fraud_alerts)

    @cached_property
    def silver(self) -> dict[str, DataFrame]:
        return silver.flat_frames({
            "transactions": self.transactions, "transaction_risk": self.risk,
            "merchants": self.merchants, "sessions": self.sessions, "devices": self.devices,
            "fraud_alerts": self.fraud_alerts,
        })

    @cached_property
    def fact_transactions(self) -> DataFrame:
        """From scores in range: the fact's own join drops those of invalid transactions."""
        scores = silver.typed("transaction_risk", self.sources.transaction_risk_scores)
        return gold.fact_transactions(
            self.transactions.valid, scores.where(fail_closed(rules.score_in_range()))
        )

    @cached_property
    def fact_sessions(self) -> DataFrame:
        return gold.fact_digital_sessions(self.sessions.valid)

    @cached_property
    def fact_alerts(self) -> DataFrame:
        return gold.fact_fraud_alerts(self.fraud_alerts.valid)

    @cached_property
    def unlinked_alerts(self) -> DataFrame:
        """The alert fact without the transaction reference, for plans that do not read it."""
        return gold.fact_fraud_alerts(
            silver.silver_split("fraud_alerts", self.sources.unlinked_fraud_alerts).valid
        )

    @cached_property
    def customers(self) -> DataFrame:
        return gold.dim_customer({
            "transactions": self.transactions.valid, "sessions": self.sessions.valid,
            "devices": self.devices.valid, "fraud_alerts": self.unlinked_alerts,
        })

    def sessions_start(self, days: int = 30) -> Column:
        return window_start(self.fact_sessions, "LoginTimestamp", days)

    def recent_sessions(self, days: int = 30) -> DataFrame:
        return trailing_window(self.fact_sessions, "LoginTimestamp", self.sessions_start(days), days)

    def profile(self, days: int = 30) -> DataFrame:
        return customer_risk_profile(
            self.fact_transactions, self.fact_sessions, self.unlinked_alerts, self.devices.valid,
            window_start(self.transactions.valid, "TransactionTimestamp", days),
            self.sessions_start(days),
            days,
        )

    @cached_property
    def accounts(self) -> DataFrame:
        return gold.dim_account(self.transactions.valid)

    @cached_property
    def merchant_dimension(self) -> DataFrame:
        return gold.dim_merchant(self.merchants.valid)

    @cached_property
    def device_dimension(self) -> DataFrame:
        return gold.dim_device(self.devices.valid)

    @cached_property
    def gold(self) -> dict[str, DataFrame]:
        return {
            "dimcustomer": self.customers,
            "dimaccount": self.accounts,
            "dimmerchant": self.merchant_dimension,
            "dimdevice": self.device_dimension,
            "dimdate": dim_date(self.spark),
            "facttransactions": self.fact_transactions,
            "factdigitalsessions": self.fact_sessions,
            "factfraudalerts": self.fact_alerts,
            "aggcustomerriskprofile": self.profile(),
        }

    def lake(self, purpose: str) -> Lake:
        return open_lake(
            self.spark, f"{purpose}_{uuid.uuid4().hex[:12]}", shared_folder(self.spark, purpose)
        )


def portable(df: DataFrame) -> DataFrame:
    """Zoned timestamps as zoneless UTC, so a result reads the same in any client time zone."""
    return df.select(*(
        F.col(field.name).cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, TimestampType) else F.col(field.name)
        for field in df.schema.fields
    ))


def without_keys(df: DataFrame) -> DataFrame:
    """A result without its hash keys, which SQL elsewhere cannot reproduce."""
    return df.drop(*(name for name in df.columns if name.endswith("SK")))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of doubles to a fixed number of decimals."""
    return df.select(*(
        F.round(F.col(name), digits[name]).alias(name) if name in digits else F.col(name)
        for name in df.columns
    ))


def rounded_profile(df: DataFrame) -> DataFrame:
    return rounded(df, TotalTransactionAmount30D=2, AverageTransactionRiskScore=6)
