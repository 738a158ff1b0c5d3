"""JSON-lines document files read against a fixed contract."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyweir import model

CORRUPT = "_corrupt_record"
# Where a document lay: later files, and later lines of a file, were written later.
LOAD_ORDER = ("_file_time", "_file", "_block", "_line")


class DocumentScan(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def document_schema(container: str) -> StructType:
    """Contract of a container; nested objects and arrays are declared as text and stay JSON text."""
    try:
        return model.DOCUMENTS[container]
    except KeyError:
        raise ValueError(f"unknown container: {container!r}") from None


def file_schema(container: str) -> StructType:
    """The contract plus the column that receives unparsable lines."""
    return StructType([*document_schema(container).fields, StructField(CORRUPT, StringType())])


def has_identity() -> Column:
    """Parsed, and both parts of the document key present and non-empty."""
    key = F.lit(True)
    for column in model.DOCUMENT_KEY:
        key = key & (F.col(column) != "")
    return F.coalesce(F.col(CORRUPT).isNull() & key, F.lit(False))


def load_position() -> list[Column]:
    """``LOAD_ORDER`` of a file scan; the line number only has to rise within one block of one file."""
    return [
        F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ]


def read_documents(
    spark: SparkSession, path: str | list[str], container: str, mode: str = "fail", positions: bool = False
) -> DataFrame | DocumentScan:
    """Scan document files; blank lines are skipped.

    ``fail`` stops the job at the first line without identity, naming its file.
    ``quarantine`` returns accepted and rejected rows, the latter with the raw line and the file.
    ``positions`` adds the columns of ``LOAD_ORDER`` to the documents.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"mode must be 'fail' or 'quarantine', got {mode!r}")
    raw = (
        spark.read.schema(file_schema(container))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    contract = document_schema(container).names
    placed = load_position() if positions else []
    file = F.col("_metadata.file_path")
    if mode == "quarantine":
        return DocumentScan(
            accepted=raw.where(has_identity()).select(*contract, *placed),
            rejected=raw.where(~has_identity()).select(*contract, CORRUPT, file.alias("file")),
        )
    complaint = F.concat(
        file, F.lit(": 'id' and 'customerId' are required: "),
        F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*contract))),
    )
    # In a filter, not a column: column pruning cannot drop the check.
    checked = F.when(has_identity(), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    return raw.where(checked).select(*contract, *placed)
