"""Document files arriving in a folder, upserted by document key as a stream.

Merge-on-read: each micro-batch appends its versions to a change log, in a folder named after the
batch, so its cost follows the batch and not the table. The current documents are the last version
per key, folded map-side. ``compact`` rewrites the log as one version per key when reads get slow.
A retried micro-batch overwrites its own folder, which makes the sink idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from tallyweir.operators.merge import latest_documents
from tallyweir.sources.documents import CORRUPT, LOAD_ORDER, document_schema, file_schema, has_identity

BATCH = "_batch"
# Load order of a version: micro-batch, then when and where its line lay.
ORDER = (BATCH, *LOAD_ORDER)


def _log_schema(container: str) -> StructType:
    return StructType([
        *document_schema(container).fields,
        *_position_fields(),
    ])


def _position_fields() -> list[StructField]:
    return [
        StructField("_file_time", TimestampType()),
        StructField("_file", StringType()),
        StructField("_block", LongType()),
        StructField("_line", LongType()),
        StructField(BATCH, IntegerType()),
    ]


def document_stream(spark: SparkSession, folder: str, container: str, files_per_batch: int = 1_000) -> DataFrame:
    """Stream of the container's lines, with where each lay; ``CORRUPT`` holds what could not be parsed."""
    lines = (
        spark.readStream.schema(file_schema(container))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .json(folder)
    )
    return lines.select(
        *document_schema(container).names,
        CORRUPT,
        F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def start_ingest(
    spark: SparkSession, folder: str, container: str, log: str, checkpoint: str,
    files_per_batch: int = 1_000, rejects: str | None = None,
) -> StreamingQuery:
    """Ingest every file present, then stop; a later start continues after the last batch.

    A line that cannot be parsed or lacks an identity goes to the folder ``rejects``, with what it
    held, its file and its batch; without such a folder it stops the stream, and nothing of its
    batch is taken. So accepted and rejected lines are all there were.

    The line number only has to rise within one block of one file, which a per-task counter does;
    no shuffle lies between scan and write, so a retried task counts the same.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("_line", F.monotonically_increasing_id())
        raw = F.coalesce(CORRUPT, F.to_json(F.struct(*document_schema(container).names)))
        good = has_identity()
        if rejects is None:
            complaint = F.concat("_file", F.lit(": 'id' and 'customerId' are required: "), raw)
            good = F.when(good, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
        else:
            bad = numbered.where(~good).select(raw.alias("line"), *LOAD_ORDER)
            bad.write.mode("overwrite").parquet(f"{rejects}/{BATCH}={batch_id}")
        numbered.where(good).drop(CORRUPT).write.mode("overwrite").parquet(f"{log}/{BATCH}={batch_id}")

    return (
        document_stream(spark, folder, container, files_per_batch)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rejected_lines(spark: SparkSession, rejects: str) -> DataFrame:
    """Lines the stream did not take: ``line``, where it lay, and the batch."""
    fields = [StructField("line", StringType()), *_position_fields()]
    return spark.read.schema(StructType(fields)).parquet(rejects)


def current_documents(spark: SparkSession, log: str, container: str) -> DataFrame:
    """The container as the log leaves it: last version per key, whole documents."""
    versions = spark.read.schema(_log_schema(container)).parquet(log)
    return latest_documents(versions, ORDER)


def compact(spark: SparkSession, log: str, container: str, target: str) -> None:
    """Write a new log holding the last version of every key, with its own load order."""
    versions = spark.read.schema(_log_schema(container)).parquet(log)
    kept = latest_documents(versions.withColumn("_at", F.struct(*ORDER)), ORDER)
    kept.select(*document_schema(container).names, "_at.*").write.partitionBy(BATCH).parquet(target)
