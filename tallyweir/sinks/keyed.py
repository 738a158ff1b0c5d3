"""M01, M02 on stored tables: merges that rewrite only the partitions a batch's keys lie in.

A keyed table is partitioned by the slot of its merge key, a hash modulo a number fixed when the table is
made, about ``SLOT_BYTES`` a slot. A merge reads the slots of the batch's keys, writes their new content to
a folder beside the table, and then replaces exactly those partitions from it. The folder is the journal:
complete, it is applied again after a lost job, with the same result; incomplete, it is dropped, and the
table is as it was. One writer at a time; a reader during the replacement may miss a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyweir.operators.merge import merge_insert_missing, merge_update_matched
from tallyweir.session import configure, scan_size
from tallyweir.sinks.tables import Lake, point_partitioned

SLOT = "_slot"
SLOT_BYTES = 128 << 20
LEAST_SLOTS, MOST_SLOTS = 16, 65_536
_JOURNAL = "_merge-"
_KEY, _SLOTS = "tallyweir.key", "tallyweir.slots"


def slot_of(key: str, slots: int) -> Column:
    """Slot of a key; a NULL key has one too."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _folder(lake: Lake, table: str) -> str:
    return f"{lake.root}/{lake.schema}/{table.lower()}"


def _files(lake: Lake, path: str):
    place = lake.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(lake.spark.sparkContext._jsc.hadoopConfiguration())


def _described(lake: Lake, table: str) -> tuple[str, int]:
    properties = {r["key"]: r["value"] for r in lake.spark.sql(f"SHOW TBLPROPERTIES {lake.name(table)}").collect()}
    if _KEY not in properties:
        raise ValueError(f"{table} is not a keyed table")
    return properties[_KEY], int(properties[_SLOTS])


def write_keyed(lake: Lake, df: DataFrame, table: str, key: str, slots: int | None = None) -> int:
    """K04 as a keyed table, replacing what the name had; returns its rows.

    Without ``slots``, as many as the volume the plan reads asks for. All files of a slot come from one task.
    """
    if slots is None:
        slots = min(max(scan_size(df).known_bytes // SLOT_BYTES, LEAST_SLOTS), MOST_SLOTS)
    data = f"{_folder(lake, table)}/{uuid.uuid4().hex}"
    placed = df.withColumn(SLOT, slot_of(key, slots)).repartition(SLOT)
    placed.write.partitionBy(SLOT).parquet(data)
    point_partitioned(lake, table, data, placed.schema, SLOT, {_KEY: key, _SLOTS: str(slots)})
    return read_keyed(lake, table).count()


def ensure_keyed(lake: Lake, table: str, key: str) -> None:
    """A table that was written plain is rewritten once, as a keyed one."""
    told = lake.spark.sql(f"SHOW TBLPROPERTIES {lake.name(table)}").where(F.col("key") == _KEY)
    if told.isEmpty():
        write_keyed(lake, lake.read(table), table, key)


def read_keyed(lake: Lake, table: str) -> DataFrame:
    """The table's own columns."""
    return lake.read(table).drop(SLOT)


def pending(lake: Lake, table: str) -> tuple[list[str], list[str]]:
    """Journals of merges that were not finished: complete ones, oldest first, and incomplete ones."""
    place, files = _files(lake, _folder(lake, table))
    if not files.exists(place):
        return [], []
    found = sorted((s for s in files.listStatus(place) if s.getPath().getName().startswith(_JOURNAL)), key=lambda s: s.getModificationTime())
    paths = [str(s.getPath()) for s in found]
    whole = [p for p in paths if files.exists(_files(lake, p + "/_SUCCESS")[0])]
    return whole, [p for p in paths if p not in whole]


def recover(lake: Lake, table: str) -> int:
    """Finish what a lost merge left behind; returns how many complete journals were applied."""
    whole, broken = pending(lake, table)
    for journal in whole:
        _apply(lake, table, journal)
    for journal in broken:
        place, files = _files(lake, journal)
        files.delete(place, True)
    return len(whole)


def _apply(lake: Lake, table: str, journal: str) -> None:
    """Replace the partitions the journal holds; the same again if it is done twice."""
    # A session of its own: its setting must not reach, nor be undone by, what other threads write.
    session = configure(lake.spark.newSession())
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = session.read.schema(lake.read(table).schema).parquet(journal).repartition(SLOT)
    rows.write.insertInto(f"{lake.schema}.{table.lower()}", overwrite=True)
    lake.spark.catalog.refreshTable(f"{lake.schema}.{table.lower()}")
    place, files = _files(lake, journal)
    files.delete(place, True)


def _merged(lake: Lake, table: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame, str], DataFrame]) -> int:
    """Merge a batch into the slots of its keys; returns how many were rewritten."""
    recover(lake, table)
    key, slots = _described(lake, table)
    touched = [r[0] for r in batch.select(slot_of(key, slots).alias(SLOT)).distinct().collect()]
    if not touched:
        return 0
    # The list, at most ``MOST_SLOTS`` numbers, prunes the scan to the partitions concerned.
    before = lake.read(table).where(F.col(SLOT).isin(touched)).drop(SLOT)
    after = merge(before, batch.select(*before.columns), key).withColumn(SLOT, slot_of(key, slots))
    journal = f"{_folder(lake, table)}/{_JOURNAL}{uuid.uuid4().hex}"
    after.repartition(SLOT).write.partitionBy(SLOT).parquet(journal)
    _apply(lake, table, journal)
    return len(touched)


def insert_missing_into(lake: Lake, table: str, batch: DataFrame) -> int:
    """M01 in place: the batch's rows whose key the table lacks; returns the slots rewritten."""
    return _merged(lake, table, batch, merge_insert_missing)


def update_matched_in(lake: Lake, table: str, batch: DataFrame) -> int:
    """M02 in place: rows take all columns of the batch's row with their key; two such rows stop the job before anything changes."""
    return _merged(lake, table, batch, merge_update_matched)
