"""Session settings the plans rely on, and shuffle sizing from what a plan really scans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Day boundaries are UTC; column names of the two sources differ only in case.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Timestamps with column statistics; the default encoding has none, so nothing could be skipped.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Valid and quarantined rows go to two open files instead of being sorted apart first.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Hash instead of sort where, at run time, every partition of a join side proves this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}

# Reducers: about 256 MiB each, but no more than the map-status bookkeeping of a wide shuffle bears.
SHUFFLE_PARTITION_BYTES = 256 << 20
MAX_SHUFFLE_PARTITIONS = 50_000
# Mappers: larger splits once a scan would need more tasks than this, up to 1 GiB each.
MAX_SCAN_TASKS = 100_000
MAX_SPLIT_BYTES = 1 << 30
SIZE_SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
UNKNOWN_SIZE = (1 << 63) - 1


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", app: str = "tallyweir") -> SparkSession:
    """Single-JVM session for tests and benches; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tallyweir-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


class ScanSize(NamedTuple):
    """Bytes of the inputs of known size, and whether that is all of them."""

    known_bytes: int
    complete: bool


def scan_size(df: DataFrame) -> ScanSize:
    """What a plan reads: the file sizes Catalyst knows, summed over the leaves of the optimized plan.

    Leaves, because the estimate of a join is the product of its sides. A leaf without statistics
    (an RDD behind it) is given the largest long, which says nothing about its size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [size for size in sizes if size < UNKNOWN_SIZE]
    return ScanSize(sum(known), len(known) == len(sizes))


def size_tasks(spark: SparkSession, *scans: DataFrame) -> None:
    """Fit shuffle width and scan split size to the volume scanned.

    Both are only ever raised: AQE coalesces a shuffle that turns out too fine, and a session that
    was set up wider stays so. A 100 TB refresh gets 100,000 scan tasks and 50,000 reducers.
    """
    volume = sum(scan_size(scan).known_bytes for scan in scans)
    _raise(spark, "spark.sql.shuffle.partitions",
           min(volume // SHUFFLE_PARTITION_BYTES, MAX_SHUFFLE_PARTITIONS))
    _raise(spark, "spark.sql.files.maxPartitionBytes",
           min(volume // MAX_SCAN_TASKS, MAX_SPLIT_BYTES))


@contextmanager
def sized_tasks(spark: SparkSession, *scans: DataFrame) -> Iterator[None]:
    """``size_tasks`` for the work inside; the caller's session is as before afterwards."""
    before = {key: spark.conf.get(key) for key in SIZE_SETTINGS}
    size_tasks(spark, *scans)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _raise(spark: SparkSession, setting: str, wanted: int) -> None:
    # A byte setting may come with a unit, "134217728b" or "128m"; the JVM parser knows them all.
    current = spark.conf.get(setting)
    now = int(current) if current.isdigit() else (
        spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(current)
    )
    if wanted > now:
        spark.conf.set(setting, str(wanted))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a temporary one, but only if driver and executors are one process: on a
    cluster each machine would write to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyweir-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
