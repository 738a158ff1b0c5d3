"""What the operators share: tables, stored hand-overs, and texts as flat byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweir.session import shared_folder

# Bytes of text a Python task works on at once; one longer text is taken alone and whole.
SLICE_BYTES = 4 << 20

# Bytes of rows that Spark hands a Python worker at once: JVM, pipe and worker each hold a batch or two.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER_A, UPPER_Z, TO_LOWER = 65, 90, 32


def modest_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_BYTES`` for Python workers from here on in the session, if they would be larger."""
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < bytes_of(spark.conf.get(BATCH_SETTING)) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the cluster's shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not what led to the table.
    """
    path = shared_folder(df.sparkSession, purpose)
    modest_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Hashes that a sample is drawn by, and how far an estimated count of distinct rows may be off.
HASHES = 1 << 40
ESTIMATE_MARGIN = 2


def least_by_hash(df: DataFrame, rows: int, *columns: str, per: str | None = None) -> DataFrame:
    """``rows`` distinct rows of ``df`` by ``columns``, or all if there are fewer: those of least hash.

    With ``per``, so many for each value of that column (null is one), however rare it is. Of rows that agree
    in the columns any one stands for all, so that copies neither crowd out other rows nor come back.

    The hashes are written once. Those below a bound, which an estimate of the distinct rows of each
    value sets with a margin, are ranked, so that what is brought together does not grow with the data.
    """
    value = F.col(per).cast("string") if per else F.lit("")
    keyed = df.withColumns({"_value": value, "_hash": F.pmod(F.xxhash64(*columns), F.lit(HASHES))})
    keys = stored(keyed.select("_value", "_hash"), "sample-keys")
    about = keys.groupBy("_value").agg(F.approx_count_distinct("_hash").alias("n"))
    quick = (F.lit(float(HASHES * ESTIMATE_MARGIN)) * (rows + 100) / F.greatest("n", F.lit(1))).cast("bigint")
    about = stored(about.select(F.col("_value").alias("_of"), quick.alias("_quick")), "sample-bounds")
    likely = keys.join(about, F.col("_value").eqNullSafe(F.col("_of"))).where(F.col("_hash") <= F.col("_quick"))
    ranked = likely.select("_of", "_hash").distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy("_of").orderBy("_hash")))
    bounds = ranked.where(F.col("rank") <= rows).groupBy("_of").agg(F.max("_hash").alias("_most"))
    bounds = stored(bounds, "sample-bounds")
    inside = F.col("_value").eqNullSafe(F.col("_of")) & (F.col("_hash") <= F.col("_most"))
    return keyed.join(bounds, inside).dropDuplicates(list(columns)).select(*(df[f"`{c}`"] for c in df.columns))


# Bits of the bitmap that tells which keys can be in a set: 4 MB, however large the set.
BITMAP_BITS = 25


def _bit(key: str) -> Column:
    # Positions count from 1 in the bitmap functions.
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS)) + 1


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that can have a key of ``keys`` (key), and those that have none for sure.

    The keys go out as a bitmap of their hashes, 1,024 rows of 4 KB, so that a join which concerns few
    rows need not shuffle all. With more keys the first part grows; it is never wrong.
    """
    bits = keys.select(_bit(key).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")
    )
    bits = F.broadcast(stored(bits, "key-bitmap"))
    marked = df.join(bits, F.bitmap_bucket_number(_bit(key)) == bits.bucket, "left")
    place = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring(bits.bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    return tuple(marked.where(c).select(*(df[f"`{name}`"] for name in df.columns)) for c in (found, ~found))


def lower_bytes() -> np.ndarray:
    """Byte to byte, A-Z in lower case."""
    lowered = np.arange(256, dtype=np.uint8)
    lowered[UPPER_A : UPPER_Z + 1] += TO_LOWER
    return lowered


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes of text, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 array, and the rows' offsets in it; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    large = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(large)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def release_memory() -> None:
    """Give freed memory back to the machine: workers are kept between tasks, and what they hold adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)
