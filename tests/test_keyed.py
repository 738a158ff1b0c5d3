"""Merges that rewrite only the partitions of a batch's keys."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyweir.operators.merge import merge_insert_missing, merge_update_matched
from tallyweir.sinks import keyed

SCHEMA = "k string, v int, s string"


@pytest.fixture
def table(lake, spark):
    rows = spark.range(1_000).selectExpr("concat('K', id) AS k", "cast(id as int) AS v", "'old' AS s").unionByName(
        spark.sql("SELECT cast(NULL as string) AS k, -1 AS v, 'old' AS s"))
    assert keyed.write_keyed(lake, rows, "T", "k", slots=32) == 1_001
    return rows


def files(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def slots(names):
    return {f.split("_slot=")[1].split("/")[0] for f in names}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_small_batch_leaves_other_partitions_files_alone(lake, folder, frame, table):
    before = files(folder)
    assert len(slots(before)) == 32
    batch = frame(SCHEMA, *((f"K{n}", n, "new") for n in (5, 998, 1_001, 1_002)), (None, 7, "new"))
    wanted = rows_of(merge_insert_missing(table, batch, "k"))
    touched = {str(r[0]) for r in batch.select(keyed.slot_of("k", 32)).collect()}
    assert keyed.insert_missing_into(lake, "T", batch) == len(touched) <= 5
    assert rows_of(keyed.read_keyed(lake, "T")) == wanted and len(wanted) == 1_004
    after = files(folder)
    same = {f for f in before if after.get(f) == before[f]}
    assert slots(before) - slots(same) <= touched and slots(set(after) - same) <= touched
    assert len(slots(same)) >= 32 - len(touched)


def test_update_equals_the_whole_merge(lake, folder, frame, table):
    batch = frame(SCHEMA, ("K3", None, "new"), ("K700", 1, None), ("absent", 1, "x"), (None, 9, "x"))
    wanted = rows_of(merge_update_matched(table, batch, "k"))
    assert 0 < keyed.update_matched_in(lake, "T", batch) <= 4
    assert rows_of(keyed.read_keyed(lake, "T")) == wanted
    before = files(folder)
    assert keyed.update_matched_in(lake, "T", batch.limit(0)) == 0 and files(folder) == before
    keyed.update_matched_in(lake, "T", batch)
    assert rows_of(keyed.read_keyed(lake, "T")) == wanted


def test_ambiguous_rows_stop_before_anything_changes(lake, folder, frame, table):
    before = files(folder)
    with pytest.raises(Exception, match="several source rows match"):
        keyed.update_matched_in(lake, "T", frame(SCHEMA, ("K3", 1, "a"), ("K3", 2, "b")))
    keyed.recover(lake, "T")
    assert files(folder) == before and keyed.pending(lake, "T") == ([], [])


def test_a_merge_lost_before_or_after_its_journal(lake, folder, frame, table, monkeypatch):
    batch = frame(SCHEMA, ("K3", 33, "new"), ("K9", 99, "new"))
    real = keyed._apply

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(keyed, "_apply", lost)
    with pytest.raises(RuntimeError):
        keyed.update_matched_in(lake, "T", batch)
    monkeypatch.setattr(keyed, "_apply", real)
    assert rows_of(keyed.read_keyed(lake, "T")) == rows_of(table)
    whole, broken = keyed.pending(lake, "T")
    assert len(whole) == 1 and not broken

    # Lost in the middle of the replacement: one of its partitions is gone already.
    slot = frame("k string", ("K3",)).select(keyed.slot_of("k", 32)).first()[0]
    for f in glob.glob(f"{folder}/**/_slot={slot}/*.parquet", recursive=True):
        if "_merge-" not in f:
            os.truncate(f, 0)
            os.replace(f, f + ".lost")
    # An unfinished journal has no mark of success.
    os.makedirs(f"{folder}/{lake.schema}/t/_merge-broken/_slot=1")
    assert keyed.recover(lake, "T") == 1 and keyed.pending(lake, "T") == ([], [])
    assert rows_of(keyed.read_keyed(lake, "T")) == rows_of(merge_update_matched(table, batch, "k"))


def test_the_scan_reads_the_slots_of_the_batch_only(lake, frame, table):
    some = lake.read("T").where(F.col(keyed.SLOT).isin([1, 2])).drop(keyed.SLOT)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_slot" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(some.inputFiles()) == 2


def test_only_keyed_tables_are_merged_in_place(lake, frame):
    from tallyweir.sinks.tables import overwrite

    overwrite(lake, frame(SCHEMA, ("a", 1, "x")), "plain")
    with pytest.raises(ValueError, match="not a keyed table"):
        keyed.insert_missing_into(lake, "plain", frame(SCHEMA, ("b", 1, "x")))
