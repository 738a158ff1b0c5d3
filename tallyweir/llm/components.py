"""Connected components by alternating stars, each round handed over as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import stored


def _to_least_neighbour(edges: DataFrame, keep) -> DataFrame:
    """Neighbours of each node, tied to the least of the node and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # Both sides of the join are tables or exchanges of their own, so a hub's neighbours can be split.
    joined = edges.join(stored(least, "least-neighbours"), "u")
    return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least_neighbour(both, F.col("v") > F.col("u"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("v"))
    return _to_least_neighbour(down, F.lit(True)).union(least)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b) that is not the least of its component.

    ``component`` is the least node that can be reached. Loops and repeated edges do no harm; NULL
    ends are ignored.
    """
    now = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").distinct()
    now = stored(now, "edges")
    state = None
    while True:
        now = stored(_small_star(stored(_large_star(now).distinct(), "large-star")).distinct(), "small-star")
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(digest) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(digest)
