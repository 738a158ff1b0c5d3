"""Silver: typed, validated source tables and the rows that failed validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame

from tallyweir import model
from tallyweir.functions import rules
from tallyweir.functions.casting import cast_timestamps, json_scalar
from tallyweir.operators.quality import REASON, VALID, Split, quarantine_split, with_verdict
from tallyweir.operators.skew import heavy_keys, mark_members
from tallyweir.sinks.tables import Lake, SplitCounts, side_by_side, write_split

# the columns that must be zoned timestamps.
TIMESTAMPS = {
    "transactions": ("TransactionTimestamp",),
    "transaction_risk": ("ScoredTimestamp",),
    "sessions": ("loginTimestamp", "logoutTimestamp"),
    "fraud_alerts": ("createdTimestamp",),
}

# JSON column -> (property, type), flattened to <prefix>_<property>.
SESSION_PARTS = {
    "device": ("device", {"deviceId": "string", "deviceType": "string", "operatingSystem": "string"}),
    "geo": ("geo", {"country": "string", "state": "string", "city": "string"}),
    "authentication": ("auth", {"method": "string", "mfaUsed": "boolean", "failedAttempts": "int"}),
}


def typed(table: str, source: DataFrame) -> DataFrame:
    """The source of a Silver table with its timestamps cast."""
    return cast_timestamps(source, *TIMESTAMPS.get(table, ()))


def with_session_columns(sessions: DataFrame) -> DataFrame:
    """The nine flattened columns beside the JSON they come from."""
    return sessions.select(
        "*",
        *(
            json_scalar(document, name, kind).alias(f"{prefix}_{name}")
            for document, (prefix, properties) in SESSION_PARTS.items()
            for name, kind in properties.items()
        ),
    )


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """Nested device, geo and authentication as columns; activities stay JSON text."""
    return with_session_columns(sessions).drop(*SESSION_PARTS)


def with_known_transactions(
    risk: DataFrame, valid_transactions: DataFrame, heavy: Sequence | None = None
) -> DataFrame:
    """Flag the scores whose transaction passed validation."""
    if heavy is None:
        heavy = heavy_keys(risk, "TransactionID")
    return mark_members(risk, valid_transactions, "TransactionID", rules.KNOWN_TRANSACTION, heavy)


def _judged(table: str, source: DataFrame, valid_transactions: DataFrame | None) -> DataFrame:
    frame = typed(table, source)
    if table != "transaction_risk":
        return frame
    if valid_transactions is None:
        raise ValueError("transaction_risk is checked against the valid transactions")
    return with_known_transactions(frame, valid_transactions)


def silver_split(
    table: str, source: DataFrame, valid_transactions: DataFrame | None = None
) -> Split:
    """The two halves of one Silver table as lazy frames."""
    split = quarantine_split(
        _judged(table, source, valid_transactions), rules.BY_TABLE[table]()
    )
    if table == "transaction_risk":
        return Split(*(half.drop(rules.KNOWN_TRANSACTION) for half in split))
    if table == "sessions":
        return Split(flatten_sessions(split.valid), split.quarantined)
    return split


def build_silver(sources: Mapping[str, DataFrame]) -> dict[str, Split]:
    """All six tables as lazy frames, by Silver name; ``sources`` by source name."""
    transactions = silver_split("transactions", sources["transactions"])
    return {
        "transactions": transactions,
        **{
            table: silver_split(table, sources[source], transactions.valid)
            for table, source in model.SILVER_SOURCE.items() if table != "transactions"
        },
    }


def flat_frames(silver: Mapping[str, Split]) -> dict[str, DataFrame]:
    """The twelve Silver tables by name."""
    return {
        **{name: split.valid for name, split in silver.items()},
        **{f"quarantine_{name}": split.quarantined for name, split in silver.items()},
    }


def write_silver_table(
    lake: Lake, table: str, source: DataFrame, valid_transactions: DataFrame | None = None
) -> SplitCounts:
    """One Silver table and its quarantine, from one scan of its source."""
    frame = _judged(table, source, valid_transactions)
    tagged = with_verdict(frame, rules.BY_TABLE[table]()).drop(rules.KNOWN_TRANSACTION)
    original = [name for name in tagged.columns if name not in (VALID, REASON)]
    published = original
    if table == "sessions":
        tagged = with_session_columns(tagged)
        published = [name for name in tagged.columns if name not in (*SESSION_PARTS, VALID, REASON)]
    return write_split(lake, tagged, table, published, original)


def refresh_silver(lake: Lake, sources: Mapping[str, DataFrame]) -> dict[str, SplitCounts]:
    """Rebuild the twelve Silver tables: each source is scanned and written once.

    Transactions go first; the scores are then checked against the written table, so a lost executor
    never re-runs both.
    """
    first = write_silver_table(lake, "transactions", sources["transactions"])
    known = lake.read("transactions")
    rest = side_by_side(lake, {
        table: partial(write_silver_table, lake, table, sources[source], known)
        for table, source in model.SILVER_SOURCE.items() if table != "transactions"
    })
    return {"transactions": first, **rest}
