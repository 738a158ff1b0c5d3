"""Loading the two source systems and applying their incremental batches to stored tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyweir import model
from tallyweir.operators.counts import row_counts
from tallyweir.operators.merge import latest_documents, upsert_documents
from tallyweir.plans.incremental import incremental_changes, incremental_transactions
from tallyweir.sinks.keyed import ensure_keyed, insert_missing_into, update_matched_in, write_keyed
from tallyweir.sinks.tables import Lake, overwrite, side_by_side
from tallyweir.sources.documents import LOAD_ORDER, read_documents
from tallyweir.sources.tables import SourceUnavailable, read_table, require_tables

# What each table is merged by.
TABLE_KEYS = {
    "transactions": "TransactionID",
    "transaction_risk_scores": "TransactionID",
    "merchants": "MerchantID",
}
TABLE_SCHEMAS = {
    "transactions": model.TRANSACTIONS,
    "transaction_risk_scores": model.RISK_SCORES,
    "merchants": model.MERCHANTS,
}


def seed_from_files(lake: Lake, folder: str) -> dict[str, int]:
    """Load the table source from ``<folder>/<table>.parquet`` into keyed tables; returns rows per table."""
    def seeded(table: str) -> int:
        source = read_table(lake.spark, f"{folder}/{table}.parquet", TABLE_SCHEMAS[table])
        return write_keyed(lake, source, table, TABLE_KEYS[table])

    return side_by_side(lake, {table: partial(seeded, table) for table in TABLE_SCHEMAS})


def apply_incremental_batch(lake: Lake, base: int, count: int, as_of: datetime) -> DataFrame:
    """M04, M05 on the stored tables, then U02: the row count of each.

    The tables must have been seeded (S06). Only the partitions of the batches' keys are rewritten. Applying
    the same batch again changes nothing, and finishes one that was lost.
    """
    require_tables(lake.spark, [f"{lake.schema}.{table}" for table in TABLE_SCHEMAS])
    for table, key in TABLE_KEYS.items():
        ensure_keyed(lake, table, key)
    new = incremental_transactions(lake.spark, base, count, as_of)
    changes = incremental_changes(lake.spark, as_of)

    def scores() -> None:
        insert_missing_into(lake, "transaction_risk_scores", new.scores)
        update_matched_in(lake, "transaction_risk_scores", changes.scores)

    side_by_side(lake, {
        "transactions": partial(insert_missing_into, lake, "transactions", new.transactions),
        "transaction_risk_scores": scores,
        "merchants": partial(insert_missing_into, lake, "merchants", changes.merchants),
    })
    return row_counts({table: lake.read(table) for table in TABLE_SCHEMAS}, "object")


def documents_in(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The containers a load folder has a ``<container>.jsonl`` for; the others are left out."""
    found = {}
    for container in model.DOCUMENT_SOURCES:
        try:
            found[container] = read_documents(
                spark, f"{folder}/{container}.jsonl", container, positions=True
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise SourceUnavailable(f"{container} is not readable: {error}") from error
    return found


def upsert_into(lake: Lake, batches: Mapping[str, DataFrame]) -> dict[str, int]:
    """M03 on the stored containers, creating them on the first load; returns rows per container.

    Of a key's versions in a batch the one loaded last stays, where the batch says in what order they
    lay (``read_documents(positions=True)``).
    """
    def merged(container: str, batch: DataFrame) -> DataFrame:
        written = [name for name in LOAD_ORDER if name in batch.columns]
        if not lake.exists(container):
            return latest_documents(batch, written)
        return upsert_documents(lake.read(container), batch, written)

    written = side_by_side(lake, {
        container: partial(overwrite, lake, merged(container, batch), container)
        for container, batch in batches.items()
    })
    return {container: result["rows"] for container, result in written.items()}
