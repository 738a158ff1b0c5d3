"""Row counts of several frames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def row_counts(frames: Mapping[str, DataFrame], name: str = "table_name") -> DataFrame:
    """One row per frame; names are lower-cased like the catalog does. Each count is one aggregate."""
    counted = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(label.lower()).alias(name), "row_count"
        )
        for label, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def counts_in_one_row(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One column per frame, each a scalar subquery."""
    spark = next(iter(frames.values())).sparkSession
    return spark.range(1).select(
        *(frame.agg(F.count(F.lit(1))).scalar().alias(label) for label, frame in frames.items())
    )


def table_inventory(layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """(layer, table_name, row_count) of every table of every layer."""
    return reduce(
        DataFrame.unionByName,
        (
            row_counts(tables).select(F.lit(layer).alias("layer"), "table_name", "row_count")
            for layer, tables in layers.items()
        ),
    )
