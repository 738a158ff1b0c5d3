"""The governed serving layer over Gold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tallyweir import model
from tallyweir.functions.masking import full_mask, partial_mask
from tallyweir.operators.checks import gate_nonempty
from tallyweir.operators.governance import PERMITTED_COLUMNS, RESTRICTED_BAND, permitted_columns, secure_rows
from tallyweir.plans.gold import MERCHANT_COLUMNS
from tallyweir.plans.risk_profile import PROFILE_COLUMNS
from tallyweir.sinks.tables import Lake, overwrite, side_by_side

# Gold tables with sensitive content: served from their own snapshot, never from Gold itself.
GOVERNED = ("dimcustomer", "dimdevice", "aggcustomerriskprofile")

# Published columns of each view; the load stamp follows where the Gold table carries it.
VIEW_COLUMNS = {
    "dimcustomer": ("CustomerSK", "CustomerID"),
    "dimdevice": (
        "DeviceSK", "DeviceID", "CustomerID", "CustomerSK", "OS", "DeviceFingerprint", "IsTrusted",
    ),
    "aggcustomerriskprofile": PROFILE_COLUMNS,
    "dimaccount": ("AccountSK", "AccountID", "CustomerID", "CustomerSK"),
    "dimmerchant": ("MerchantSK", *MERCHANT_COLUMNS),
    "dimdate": (
        "DateKey", "FullDate", "Year", "Quarter", "Month", "MonthName", "Day", "DayOfWeek",
        "DayName", "IsWeekend",
    ),
    # The customer id of a transaction is not served, only its key.
    "facttransactions": (
        "TransactionID", "CustomerSK", "AccountSK", "MerchantSK", "DateKey",
        "TransactionTimestamp", "Amount", "Currency", "TransactionType", "Channel", "Country",
        "DeviceID", "CardPresent", "TransactionStatus", "RiskScore", "RiskBand",
    ),
    "factdigitalsessions": (
        "SessionID", "CustomerSK", "CustomerID", "DeviceID", "DeviceSK", "DateKey",
        "LoginTimestamp", "LogoutTimestamp", "DeviceType", "DeviceOS", "GeoCountry", "GeoState",
        "GeoCity", "GeoIpAddress", "AuthMethod", "AuthMfaUsed", "AuthFailedAttempts",
        "ActivitiesJson",
    ),
    "factfraudalerts": (
        "AlertID", "CustomerSK", "CustomerID", "TransactionID", "DateKey", "AlertTimestamp",
        "Severity", "AlertType",
    ),
}

# Masked column of a governed table.
MASKS = {
    "dimcustomer": ("CustomerID", partial_mask),
    "dimdevice": ("DeviceFingerprint", full_mask),
}


def served(table: str, df: DataFrame) -> DataFrame:
    """The published projection of a table."""
    stamp = [model.LOAD_STAMP] if model.LOAD_STAMP in df.columns else []
    return df.select(*VIEW_COLUMNS[table], *stamp)


def governed(
    table: str, snapshot: DataFrame, claim: str | None = None, privileged: bool = False
) -> DataFrame:
    """Masks and row security over a snapshot; an owner (``privileged``) sees unmasked values.

    Row security follows the claim alone, for owners too.
    """
    view = served(table, snapshot)
    if table == "aggcustomerriskprofile":
        return secure_rows(view, claim)
    if privileged or table not in MASKS:
        return view
    column, mask = MASKS[table]
    return view.withColumn(column, mask(column))


def serving_views(
    gold: Mapping[str, DataFrame],
    snapshots: Mapping[str, DataFrame] | None = None,
    claim: str | None = None,
    privileged: bool = False,
    plain_reader: bool = False,
) -> dict[str, DataFrame]:
    """The nine views as frames; governed ones over their snapshots where given.

    A ``plain_reader`` sees only the permitted columns of the tables that have a list of them (P14).
    """
    base = {**gold, **(snapshots or {})}
    views = {
        table: governed(table, base[table], claim, privileged) if table in GOVERNED
        else served(table, base[table])
        for table in VIEW_COLUMNS
    }
    if plain_reader:
        views |= {table: permitted_columns(views[table], names) for table, names in PERMITTED_COLUMNS.items()}
    return views


class Published(NamedTuple):
    views: dict[str, DataFrame]
    gold_rows: dict[str, int]


def publish(
    serving: Lake, gold: Mapping[str, DataFrame], claim: str | None = None, privileged: bool = False,
    plain_reader: bool = False,
) -> Published:
    """V02, K05, P16 in one step: gate, snapshot, then views under the serving schema's name.

    Security is part of the step, so a refreshed snapshot is never reachable without it. The views
    belong to the session, since the claim does.
    """
    gold_rows = gate_nonempty({table: gold[table] for table in model.GOLD_TABLES})
    side_by_side(serving, {
        table: partial(overwrite, serving, gold[table], f"_base_{table}") for table in GOVERNED
    })
    snapshots = {table: serving.read(f"_base_{table}") for table in GOVERNED}
    views = serving_views(gold, snapshots, claim, privileged, plain_reader)
    for table, view in views.items():
        view.createOrReplaceTempView(f"{serving.schema}_{table}")
    return Published(views, gold_rows)


def restricted_rows_visible(snapshot: DataFrame, claim: str | None) -> DataFrame:
    """Restricted-band rows a session with this claim sees."""
    return (
        governed("aggcustomerriskprofile", snapshot, claim)
        .where(F.col("CustomerRiskBand") == RESTRICTED_BAND)
        .agg(F.count(F.lit(1)).alias("visible"))
    )


def preview(view: DataFrame, by: Sequence[str], n: int = 5) -> DataFrame:
    """A first look at a view, its first rows by the view's key."""
    return view.orderBy(*by).limit(n)
