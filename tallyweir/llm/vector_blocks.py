"""Vectors with whole components, and rows dealt out in blocks that meet a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a block; 32,768 of 64 dimensions are 8 MB.
BLOCK_ROWS = 32_768
# What takes part in exact arithmetic stays within 64 bits: sums of products below 2 ** EXACT_BITS.
EXACT_BITS = 62


def finite(embedding: Column) -> Column:
    """Not null, and every component a finite number; never NULL itself."""
    real = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(real, F.lit(False))


def whole(embedding: Column, scale: int, spare_bits: int = 0) -> Column:
    """Every component as ``floor(scale * x)`` in double precision.

    Components are held to the magnitude at which no sum of products of two vectors of this length,
    ``2 ** spare_bits`` times over, leaves 64 bits: 2 ** 28 for 64 components and no spare bits.
    """
    limit = F.least(F.lit(2.0**30), F.sqrt(F.lit(2.0 ** (EXACT_BITS - spare_bits)) / F.greatest(F.size(embedding), F.lit(1))))
    return F.transform(
        embedding,
        lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, limit), -limit)).cast("int"),
    )


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), dims)


def met_in_blocks(rows: DataFrame, asked: DataFrame, total: int) -> DataFrame:
    """``rows`` and ``asked`` (both with vec_id) in one frame: of each block its rows, then all that is asked.

    A row lies in one block, by the hash of its id; what is asked goes to every block, so that it
    travels once for each ``BLOCK_ROWS`` rows and nothing of either passes through the driver. The
    columns ``block`` and ``asked`` come first; a task finds its blocks one after the other.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-total // BLOCK_ROWS))
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), "*")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), "*")
    both = own.unionByName(every, allowMissingColumns=True)
    return both.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "asked", "vec_id")


def runs(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that agree in the columns, which hold no nulls."""
    new = np.zeros(batch.num_rows, bool)
    for name in columns:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for start, stop in zip(bounds, bounds[1:], strict=False):
        if stop > start:
            yield batch.slice(start, stop - start)
