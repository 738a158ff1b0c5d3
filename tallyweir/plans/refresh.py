"""One full refresh, from source gate to reconciliation, with a run-log row per stage."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame

from tallyweir import model
from tallyweir.operators.checks import gate_nonempty
from tallyweir.plans import audit, consumption, gold, serving, silver
from tallyweir.plans.audit import StageCounts, logged_stage
from tallyweir.session import sized_tasks
from tallyweir.sinks.tables import Lake
from tallyweir.sources.tables import SourceUnavailable


class Lakes(NamedTuple):
    silver: Lake
    gold: Lake
    serving: Lake


def silver_frames(lakes: Lakes) -> dict[str, DataFrame]:
    return {
        name: lakes.silver.read(name) for name in (*model.SILVER_TABLES, *model.QUARANTINE_TABLES)
    }


def gold_frames(lakes: Lakes) -> dict[str, DataFrame]:
    return {name: lakes.gold.read(name) for name in model.GOLD_TABLES}


def _gate(sources: Mapping[str, DataFrame | None], names: tuple[str, ...]) -> StageCounts:
    absent = [name for name in names if sources.get(name) is None]
    if absent:
        raise SourceUnavailable(f"sources not readable: {', '.join(absent)}")
    return StageCounts(sum(gate_nonempty({name: sources[name] for name in names}).values()), 0)


def run_medallion(
    lakes: Lakes,
    sources: Mapping[str, DataFrame | None],
    run_id: str,
    run_date: str = "",
    loaded_at: datetime | None = None,
    claim: str | None = None,
    days: int = 30,
) -> dict[str, DataFrame]:
    """Gate both sources, rebuild Silver and Gold, publish, reconcile; returns the serving views.

    Both source systems are checked even when the first one fails. Stages hand over by written
    tables, so a later stage never recomputes an earlier one.
    """
    spark = lakes.gold.spark
    run_date = run_date or f"{datetime.now(timezone.utc):%Y-%m-%d}"
    with sized_tasks(spark, *(df for df in sources.values() if df is not None)):
        views: dict[str, DataFrame] = {}

        def stage(name, work):
            return logged_stage(lakes.gold, run_id, run_date, name, work)

        failures = []
        for kind, names in (("tables", model.TABLE_SOURCES), ("documents", model.DOCUMENT_SOURCES)):
            try:
                stage(f"source_validation_{kind}", lambda: _gate(sources, names))
            except Exception as error:  # logged by the stage; raised once both were checked
                failures.append(error)
        if failures:
            raise failures[0]

        def build_silver() -> StageCounts:
            counts = silver.refresh_silver(lakes.silver, sources).values()
            return StageCounts(sum(c.read for c in counts), sum(c.valid for c in counts))

        def build_gold() -> StageCounts:
            written = gold.refresh_gold(lakes.gold, silver_frames(lakes), loaded_at, days)
            return StageCounts(from_silver.written, sum(written.values()))

        def publish() -> StageCounts:
            published = serving.publish(lakes.serving, gold_frames(lakes), claim)
            views.update(published.views)
            return StageCounts(sum(published.gold_rows.values()), 0)

        def reconcile() -> StageCounts:
            results = audit.reconcile(
                spark, sources, silver_frames(lakes), gold_frames(lakes), run_id, run_date
            )
            return audit.record_reconciliation(lakes.gold, results)

        from_silver = stage("silver_transform", build_silver)
        stage("gold_build", build_gold)
        stage("warehouse_publish", publish)
        stage("reconciliation", reconcile)
        stage("pipeline_complete", lambda: StageCounts(0, 0))
        return views


def run_consumption(lakes: Lakes, run_at: datetime) -> dict[str, int]:
    """The consumption tables, after a refresh."""
    return consumption.write_consumption(
        lakes.gold, silver_frames(lakes), gold_frames(lakes), run_at
    )
