"""Table scans and small generated frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class SourceUnavailable(RuntimeError):
    """A table or path a plan needs cannot be read."""


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet scan; a declared schema saves the footer-inference job and prunes unknown columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """Scan of a catalog table; a missing table is reported by name."""
    try:
        return spark.table(name)
    except AnalysisException as error:
        raise SourceUnavailable(f"table {name} is not readable: {error}") from error


def read_path(
    spark: SparkSession, path: str, on_missing: str = "raise", fmt: str = "parquet"
) -> DataFrame | None:
    """Scan of a table outside the catalog. ``on_missing="none"`` gives None for audits that go on."""
    if on_missing not in ("raise", "none"):
        raise ValueError(f"on_missing must be 'raise' or 'none', got {on_missing!r}")
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if on_missing == "none":
            return None
        raise SourceUnavailable(f"path {path} is not readable: {error}") from error


def require_tables(spark: SparkSession, names: Iterable[str]) -> None:
    """Fail once, naming every missing table."""
    missing = [name for name in names if not spark.catalog.tableExists(name)]
    if missing:
        raise SourceUnavailable(f"missing tables: {', '.join(missing)}")


def ordinals(spark: SparkSession, base: int, count: int) -> DataFrame:
    """The ``count`` numbers from ``base`` on, as column ``Ordinal``."""
    return spark.range(base, base + count).withColumnRenamed("id", "Ordinal")


def rows_frame(spark: SparkSession, rows: Iterable[Sequence], schema: StructType) -> DataFrame:
    """A few driver-side rows; the schema is explicit because a column may be all NULL.

    Through Arrow, so that the plan holds the rows themselves and knows how few they are: a merge
    with them broadcasts instead of shuffling its target.
    """
    rows = list(rows)
    arrow = to_arrow_schema(schema)
    columns = zip(*rows) if rows else ([] for _ in schema)
    return spark.createDataFrame(
        pa.Table.from_arrays(
            [pa.array(list(values), field.type) for values, field in zip(columns, arrow)], schema=arrow
        ),
        schema,
    )
