"""Run log and reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweir import model
from tallyweir.operators.counts import table_inventory
from tallyweir.sinks.tables import Lake, append_audit
from tallyweir.sources.tables import rows_frame

RUN_LOG_TABLE = "control_pipeline_run_log"
RECONCILIATION_TABLE = "reconciliation_results"

# Silver table -> the Gold table that must hold exactly its rows.
ONE_TO_ONE = {
    "merchants": "dimmerchant",
    "devices": "dimdevice",
    "transactions": "facttransactions",
    "sessions": "factdigitalsessions",
    "fraud_alerts": "factfraudalerts",
}
# Gold table with a grain of its own -> (what it is built from, what one row is).
OWN_GRAIN = {
    "dimcustomer": ("*", "one row per customer any of the four customer-bearing tables names"),
    "dimaccount": ("transactions", "one row per account and customer pair of the transactions"),
    "aggcustomerriskprofile": (
        "*", "one row per customer, each source windowed by its own last day",
    ),
}


class ReconciliationFailed(RuntimeError):
    """At least one reconciliation check does not hold."""


class StageCounts(NamedTuple):
    """Rows a stage read and wrote; quarantined rows do not count as written."""

    read: int
    written: int


def _moment(value: datetime | str | None, default: datetime) -> datetime:
    if not value:
        return default
    parsed = datetime.fromisoformat(value) if isinstance(value, str) else value
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def run_log_row(
    spark: SparkSession, run_id: str, stage: str, status: str,
    start_ts: datetime | str | None = None, end_ts: datetime | str | None = None,
    rows_read: int = 0, rows_written: int = 0, error_message: str | None = None,
    run_date: str = "",
) -> DataFrame:
    """One run-log row. Blank moments are now, a blank message is NULL, a blank date is today."""
    if status not in model.RUN_STATUSES:
        raise ValueError(f"status must be one of {model.RUN_STATUSES}, got {status!r}")
    now = datetime.now(timezone.utc)
    row = (
        run_id, stage, status, _moment(start_ts, now), _moment(end_ts, now),
        int(rows_read), int(rows_written), error_message or None, run_date or f"{now:%Y-%m-%d}",
    )
    return rows_frame(spark, [row], model.RUN_LOG)


def log_run(lake: Lake, **fields) -> None:
    append_audit(lake, run_log_row(lake.spark, **fields), RUN_LOG_TABLE)


def logged_stage(
    lake: Lake, run_id: str, run_date: str, stage: str, work: Callable[[], StageCounts]
) -> StageCounts:
    """Run a stage and log how it ended; a failure is logged and then stops the run."""
    started = datetime.now(timezone.utc)
    try:
        counts = work()
    except Exception as error:
        log_run(
            lake, run_id=run_id, stage=stage, status="Failed", start_ts=started,
            error_message=str(error), run_date=run_date,
        )
        raise
    log_run(
        lake, run_id=run_id, stage=stage, status="Succeeded", start_ts=started,
        rows_read=counts.read, rows_written=counts.written, run_date=run_date,
    )
    return counts


def layer_counts(
    layers: Mapping[str, Mapping[str, DataFrame | None]]
) -> dict[str, dict[str, int | None]]:
    """Rows of every table of every layer, all counted in one job; None for a missing table."""
    present = {
        layer: {name: df for name, df in frames.items() if df is not None}
        for layer, frames in layers.items()
    }
    counted = {
        (row["layer"], row["table_name"]): row["row_count"]
        for row in table_inventory(present).collect()
    }
    return {
        layer: {name: counted.get((layer, name.lower())) for name in frames}
        for layer, frames in layers.items()
    }


def _source_kind(silver_table: str) -> str:
    return "tables" if model.SILVER_SOURCE[silver_table] in model.TABLE_SOURCES else "documents"


def reconciliation_rows(
    source: Mapping[str, int | None], silver: Mapping[str, int], gold: Mapping[str, int]
) -> list[tuple]:
    """The 20 checks (6 + 5 + 3 + 6) on table counts; a missing source fails its check."""
    rows = []
    for table, source_name in model.SILVER_SOURCE.items():
        rebuilt = silver[table] + silver[f"quarantine_{table}"]
        rows.append((
            _source_kind(table), source_name, source[source_name], rebuilt, "row_count",
            "PASS" if source[source_name] == rebuilt else "FAIL",
            "Valid plus quarantined rows against the source.",
        ))
    for table, gold_table in ONE_TO_ONE.items():
        rows.append((
            "silver_gold", f"{table}->{gold_table}", silver[table], gold[gold_table], "row_count",
            "PASS" if silver[table] == gold[gold_table] else "FAIL",
            "Gold keeps every Silver row of this table.",
        ))
    for gold_table, (origin, grain) in OWN_GRAIN.items():
        rows.append((
            "silver_gold", f"{origin}->{gold_table}", None, gold[gold_table], "grain_note", "PASS",
            f"Not compared with a Silver count: {grain}.",
        ))
    for table in model.SILVER_TABLES:
        quarantined = silver[f"quarantine_{table}"]
        rows.append((
            _source_kind(table), f"quarantine_{table}", None, quarantined, "quarantine_count",
            "PASS", f"{quarantined} rows quarantined.",
        ))
    return rows


def reconcile(
    spark: SparkSession,
    sources: Mapping[str, DataFrame | None],
    silver: Mapping[str, DataFrame],
    gold: Mapping[str, DataFrame],
    run_id: str,
    run_date: str,
) -> DataFrame:
    """R01-R04 as a frame. What reaches the driver is one number per table, all counted in one job."""
    counted = layer_counts({"source": sources, "silver": silver, "gold": gold})
    checks = reconciliation_rows(counted["source"], counted["silver"], counted["gold"])
    return rows_frame(
        spark, [(*check, run_id, run_date) for check in checks], model.RECONCILIATION
    )


def record_reconciliation(lake: Lake, results: DataFrame) -> StageCounts:
    """Append the results, then stop the run if any check failed."""
    append_audit(lake, results, RECONCILIATION_TABLE)
    total, failed = results.agg(
        F.count(F.lit(1)), F.count_if(F.col("status") == "FAIL")
    ).first()
    if failed:
        raise ReconciliationFailed(
            f"{failed} reconciliation check(s) failed, see {RECONCILIATION_TABLE}"
        )
    return StageCounts(total, total)
