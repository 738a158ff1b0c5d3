"""Writes. A table name points at a folder holding one complete version.

Every overwrite goes to a new folder and then repoints the name, so a plan may read the table it
replaces, a failed write leaves the old version in place, and older versions stay for comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import partial
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyweir import model
from tallyweir.functions.casting import quoted_identifier
from tallyweir.operators.months import MONTH, by_month
from tallyweir.operators.quality import REASON, VALID
from tallyweir.operators.windows import last_day


class Lake(NamedTuple):
    """A schema of the catalog and the shared folder its tables live in."""

    spark: SparkSession
    schema: str
    root: str

    def name(self, table: str) -> str:
        return f"{quoted_identifier(self.schema)}.{quoted_identifier(table.lower())}"

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.schema}.{table.lower()}")

    def create(self) -> Lake:
        self.spark.sql(
            f"CREATE SCHEMA IF NOT EXISTS {quoted_identifier(self.schema)} LOCATION '{self.root}/{self.schema}'"
        )
        return self


def open_lake(spark: SparkSession, schema: str, root: str) -> Lake:
    return Lake(spark, schema, root.rstrip("/")).create()


def _new_folder(lake: Lake, table: str) -> str:
    return f"{lake.root}/{lake.schema}/{table.lower()}/{uuid.uuid4().hex}"


def _literal(text: str) -> str:
    """A string of SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def point_partitioned(
    lake: Lake, table: str, folder: str, schema: StructType, partition: str, properties: Mapping[str, str] | None = None
) -> None:
    """Make the name a table over the folder's partitions; ``partition`` is its last column."""
    lake.spark.sql(f"DROP TABLE IF EXISTS {lake.name(table)}")
    columns = ", ".join(f"{quoted_identifier(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    told = ", ".join(f"{_literal(k)} = {_literal(v)}" for k, v in (properties or {}).items())
    lake.spark.sql(
        f"CREATE TABLE {lake.name(table)} ({columns}) USING parquet PARTITIONED BY ({quoted_identifier(partition)}) "
        f"LOCATION {_literal(folder)}" + (f" TBLPROPERTIES ({told})" if told else "")
    )
    lake.spark.catalog.recoverPartitions(f"{lake.schema}.{table.lower()}")


def _point(lake: Lake, table: str, folder: str, schema: StructType) -> None:
    """Repoint the name: in place where the schema stays, else by recreating the external table.

    Neither touches files, so a plan already reading the old version finishes on it.
    """
    if lake.exists(table) and lake.read(table).schema == schema:
        lake.spark.sql(f"ALTER TABLE {lake.name(table)} SET LOCATION '{folder}'")
        return
    lake.spark.sql(f"DROP TABLE IF EXISTS {lake.name(table)}")
    lake.spark.catalog.createTable(
        f"{lake.schema}.{table.lower()}", path=folder, source="parquet", schema=schema
    )


def overwrite(lake: Lake, df: DataFrame, table: str, **measures: Column) -> dict[str, Any]:
    """Full refresh, schema replaced; returns ``rows`` and the measures, taken by the same job."""
    folder = _new_folder(lake, table)
    observed = Observation()
    named = [F.count(F.lit(1)).alias("rows"), *(m.alias(name) for name, m in measures.items())]
    df.observe(observed, *named).write.parquet(folder)
    _point(lake, table, folder, df.schema)
    return observed.get


def write_gold(
    lake: Lake, df: DataFrame, table: str, loaded_at: datetime | None = None, **measures: Column
) -> dict[str, Any]:
    """Overwrite with the load stamp."""
    stamp = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    return overwrite(lake, df.withColumn(model.LOAD_STAMP, stamp), table, **measures)


def write_by_month(lake: Lake, df: DataFrame, table: str, moment: str) -> dict[str, Any]:
    """K01 with a partition for each month of ``moment``; returns ``rows`` and ``last``, the last day seen."""
    folder = _new_folder(lake, table)
    observed = Observation()
    placed = by_month(df, moment)
    counted = placed.observe(observed, F.count(F.lit(1)).alias("rows"), last_day(moment).alias("last"))
    counted.write.partitionBy(MONTH).parquet(folder)
    point_partitioned(lake, table, folder, placed.schema, MONTH)
    return observed.get


def write_gold_by_month(
    lake: Lake, df: DataFrame, table: str, moment: str, loaded_at: datetime | None = None
) -> dict[str, Any]:
    """K02 for a fact that is windowed by ``moment``."""
    stamp = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    return write_by_month(lake, df.withColumn(model.LOAD_STAMP, stamp), table, moment)


def write_result(lake: Lake, df: DataFrame, table: str, run_at: datetime) -> int:
    """Overwrite a consumption result, all tables of a run sharing one stamp; returns its rows."""
    stamped = df.withColumn("_demo_run_at", F.lit(run_at).cast("timestamp"))
    return overwrite(lake, stamped, table)["rows"]


def append_audit(lake: Lake, df: DataFrame, table: str) -> None:
    """Append-only audit rows; the first write creates the table."""
    if not lake.exists(table):
        _point(lake, table, _new_folder(lake, table), df.schema)
    df.write.insertInto(f"{lake.schema}.{table.lower()}")


class SplitCounts(NamedTuple):
    read: int
    valid: int
    quarantined: int


def write_split(
    lake: Lake, tagged: DataFrame, table: str, valid_columns: list[str], quarantine_columns: list[str]
) -> SplitCounts:
    """Write a tagged frame once and publish its halves as two tables.

    One scan and one job for both: the files are partitioned by the verdict, and each table declares
    only its own columns over its own partition folder. The counts are observed on the way.
    """
    folder = _new_folder(lake, table)
    counted = Observation()
    (
        tagged.observe(
            counted,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(VALID)).alias("valid"),
        )
        .write.partitionBy(VALID)
        .parquet(folder)
    )
    _point(lake, table, f"{folder}/{VALID}=true", _subset(tagged, valid_columns))
    _point(
        lake, f"quarantine_{table}", f"{folder}/{VALID}=false",
        _subset(tagged, [*quarantine_columns, REASON]),
    )
    seen = counted.get
    return SplitCounts(seen["rows"], seen["valid"], seen["rows"] - seen["valid"])


def _subset(df: DataFrame, columns: list[str]) -> StructType:
    return StructType([df.schema[name] for name in columns])


def side_by_side(lake: Lake, writes: Mapping[str, Callable[[], Any]]) -> dict[str, Any]:
    """Submit independent writes together, so that the tail of one job does not leave the cluster idle."""
    with ThreadPoolExecutor(max_workers=min(8, len(writes))) as pool:
        running = {
            name: pool.submit(inheritable_thread_target(lake.spark)(write))
            for name, write in writes.items()
        }
        return {name: job.result() for name, job in running.items()}


def vacuum(lake: Lake, table: str, keep: int = 2) -> list[str]:
    """Remove superseded versions of a table but the ``keep`` latest; returns the folders removed.

    The version the name points at always stays, whatever its age, and so does any folder that other
    tables of the schema point into (a split write serves two). Run it when no plan still reads an
    old version.
    """
    spark = lake.spark
    live = {path.split("://")[-1].lstrip("/") for name in spark.catalog.listTables(lake.schema) if not name.isTemporary
            for path in [_location(lake, name.name)]}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{lake.root}/{lake.schema}/{table.lower()}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    # Folders with an underscore are journals of merges, which may still have to be finished.
    versions = [s for s in files.listStatus(folder) if not s.getPath().getName().startswith("_")]
    versions.sort(key=lambda s: -s.getModificationTime())
    plain = lambda status: status.getPath().toUri().getPath().lstrip("/")
    superseded = [v for v in versions if not any((used + "/").startswith(plain(v) + "/") for used in live)]
    removed = []
    for version in superseded[max(0, keep):]:
        files.delete(version.getPath(), True)
        removed.append(str(version.getPath()))
    return removed


def _location(lake: Lake, table: str) -> str:
    described = lake.spark.sql(f"DESCRIBE TABLE EXTENDED {lake.name(table)}")
    path = described.where("col_name = 'Location'").first()["data_type"]
    return lake.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()


def seed_tables(lake: Lake, sources: dict[str, DataFrame]) -> dict[str, int]:
    """Load each source into its table, replacing what is there; returns rows per table."""
    written = side_by_side(
        lake, {table: partial(overwrite, lake, df, table) for table, df in sources.items()}
    )
    return {table: result["rows"] for table, result in written.items()}
