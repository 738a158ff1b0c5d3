"""Hard negatives by a vertical scan of columns that narrows a set of candidates.

A block of rows is held by dimension. An anchor reads the dimensions in falling order of its own
magnitude there; what the dimensions not yet read can still add lies between two sums of the block's
least and greatest values. After every few dimensions the candidates whose bounds rule them out leave
the set, until the scores of those left are exact. A first scan finds each anchor's positives, the
second the rows of other labels inside the window of scores that each positive opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm.common import release_memory, stored
from tallyweir.llm.vector_blocks import finite, matrix, met_in_blocks, runs, whole

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score, as a percentage of its positive's.
LOW_PERCENT, HIGH_PERCENT = 80, 100
# Dimensions read between two looks at the bounds.
STEP = 8
# Whole numbers that doubles hold exactly.
EXACT_DOUBLE = 1 << 53

FOUND_POSITIVES = "anchor_id bigint, vec_id bigint, score bigint"
FOUND_NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


class Columns:
    """Rows of one length by dimension, those of a label side by side."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, labels = ids[order], labels[order]
        self.whole = np.ascontiguousarray(vectors[order].T)
        self.most = int(np.abs(vectors).max(initial=0))
        self.real = self.whole.astype(np.float64)
        self.labels, self.starts = np.unique(labels, return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))
        # Least and greatest value of each dimension, by label and over all.
        self.label_low = np.minimum.reduceat(self.whole, self.starts, axis=1)
        self.label_high = np.maximum.reduceat(self.whole, self.starts, axis=1)
        self.low, self.high = self.label_low.min(axis=1), self.label_high.max(axis=1)

    def fitting(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns and the anchor as doubles, where these are exact, else as integers."""
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT_DOUBLE:
            return self.real, anchor.astype(np.float64)
        return self.whole, anchor

    def of_label(self, label: int) -> tuple[int, int, int]:
        """The label's place, and its rows' bounds; an unknown label has none."""
        at = int(np.searchsorted(self.labels, label))
        if at < len(self.labels) and self.labels[at] == label:
            return at, int(self.starts[at]), int(self.ends[at])
        return at, 0, 0


def _steps(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """The dimensions to read next, and the least and the most that all later ones can add."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    one, other = anchor[order] * low[order], anchor[order] * high[order]
    least, most = np.minimum(one, other), np.maximum(one, other)
    for at in range(0, max(len(order), 1), STEP):
        yield order[at : at + STEP], least[at + STEP :].sum(), most[at + STEP :].sum()


def positives(block: Columns, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's ``k`` best rows of the label, the anchor's own left out."""
    at, start, end = block.of_label(label)
    alive = np.arange(start, end)
    alive = alive[block.ids[start:end] != anchor_id]
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    columns, anchor = block.fitting(anchor)
    scores = np.zeros(len(alive), columns.dtype)
    for dims, least, most in _steps(anchor, block.label_low[:, at], block.label_high[:, at]):
        scores += anchor[dims] @ columns[dims[:, None], alive]
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            kept = scores + most >= kth + least
            alive, scores = alive[kept], scores[kept]
    ids = block.ids[alive]
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best].astype(np.int64)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score between the percentages of a positive's; empty below zero."""
    return -(-low * score // 100), high * score // 100


def negatives(block: Columns, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ids and scores of the block's ``k`` best rows of other labels in it."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, start, end = block.of_label(label)
    alive = np.concatenate((np.arange(start), np.arange(end, len(block.ids))))
    if not len(alive):
        return [none] * len(windows)
    columns, anchor = block.fitting(anchor)
    scores = None
    for dims, least, most in _steps(anchor, block.low, block.high):
        if scores is None:
            scores = (anchor[dims] @ columns[dims])[alive]
        else:
            scores += anchor[dims] @ columns[dims[:, None], alive]
        lowest, greatest = scores + least, scores + most
        kept = np.zeros(len(scores), bool)
        for low, high in windows:
            inside = lowest[(lowest >= low) & (greatest <= high)]
            if len(inside) >= k:
                low = max(low, np.partition(inside, len(inside) - k)[len(inside) - k])
            kept |= (greatest >= low) & (lowest <= high)
        alive, scores = alive[kept], scores[kept]
        if not len(alive):
            return [none] * len(windows)
    ids, scores = block.ids[alive], scores.astype(np.int64)
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    found = []
    for low, high in windows:
        chosen = np.flatnonzero((scores >= low) & (scores <= high))[:k]
        found.append((ids[chosen], scores[chosen]))
    return found


class Anchor(NamedTuple):
    id: int
    label: int
    vector: np.ndarray
    positives: list


def _blocks(batches: Iterator[pa.RecordBatch], answer: Callable) -> Iterator[pa.RecordBatch]:
    """``answer(columns, anchors)`` for what is asked of each block, batch by batch.

    A task holds the columns of one block and a batch of anchors.
    """
    number, parts, built = None, [], {}
    for batch in batches:
        for run in runs(batch, "block", "asked"):
            block = run.column("block")[0].as_py()
            if block != number:
                number, parts, built = block, [], {}
            if not run.column("asked")[0].as_py():
                parts.append(run)
                continue
            if parts:
                built, parts = _built(parts), []
            yield answer(built, run)
    release_memory()


def _built(parts: list[pa.RecordBatch]) -> dict[int, Columns]:
    rows = pa.Table.from_batches(parts).select(["vec_id", "label", "vector"]).combine_chunks()
    vectors = rows.column("vector").combine_chunks()
    sizes = vectors.value_lengths().to_numpy()
    ids, labels = (rows.column(n).to_numpy() for n in ("vec_id", "label"))
    built = {}
    for dims in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dims)
        built[dims] = Columns(ids[own], labels[own], matrix(vectors.take(pa.array(own)), dims))
    return built


def _anchors(run: pa.RecordBatch) -> Iterator[Anchor]:
    lists = run.column("vector")
    flat, offsets = np.asarray(lists.flatten(), np.int64), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    given = run.column("positives").to_pylist()
    for i, (own, label) in enumerate(zip(run.column("vec_id").to_pylist(), run.column("label").to_pylist(), strict=True)):
        yield Anchor(own, label, flat[offsets[i] : offsets[i + 1]], given[i])


def _frame(columns: list[list], names: str) -> pa.RecordBatch:
    joined = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(joined, names=[n.split()[0] for n in names.split(", ")])


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def answer(built, run):
        found = [[], [], []]
        for a in _anchors(run):
            if len(a.vector) in built:
                ids, scores = positives(built[len(a.vector)], a.id, a.label, a.vector, k)
                for column, values in zip(found, (np.full(len(ids), a.id), ids, scores), strict=True):
                    column.append(values)
        return _frame(found, FOUND_POSITIVES)

    return _blocks(batches, answer)


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    def answer(built, run):
        found = [[], [], [], [], []]
        for a in _anchors(run):
            if len(a.vector) not in built:
                continue
            windows = [window(p["score"], low, high) for p in a.positives]
            for p, (ids, scores) in zip(a.positives, negatives(built[len(a.vector)], a.label, a.vector, windows, k), strict=True):
                own = (np.full(len(ids), v) for v in (a.id, p["vec_id"], p["score"]))
                for column, values in zip(found, (*own, ids, scores), strict=True):
                    column.append(values)
        return _frame(found, FOUND_NEGATIVES)

    return _blocks(batches, answer)


def mine(rows: DataFrame, anchors: DataFrame, scale: int = SCALE, n_positives: int = POSITIVES,
         n_negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the ids of ``anchors`` (vec_id).

    ``rows`` has vec_id, label and embedding, of which other columns are ignored. A score is the inner
    product of ``floor(scale * x)``; higher comes first, ties by the smaller id. An anchor's positives are
    its first ``n_positives`` other rows of its label; for each, the first ``n_negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` per cent of the positive's are returned. A
    positive below zero opens an empty window; with fewer rows than asked for all are taken; an anchor
    that is no row, or without positives, gets nothing, and so does an empty table.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Empty
    vectors have score 0 with each other; vectors of different lengths never meet. An id that is repeated is one row, with its
    smallest label and then vector. Every row is scored against every anchor of its length, exactly.
    """
    usable = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    usable = usable.select("vec_id", F.struct("label", whole(F.col("embedding"), scale).alias("vector")).alias("row"))
    single = stored(usable.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*"), "whole-vectors")
    total = single.count()
    asked = single.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi")
    nothing = F.lit(None).cast("array<struct<vec_id: bigint, score: bigint>>").alias("positives")

    near = met_in_blocks(single.select("*", nothing), asked.select("*", nothing), total).mapInArrow(
        lambda batches: _positives(batches, n_positives), FOUND_POSITIVES)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = (
        near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_positives)
        .groupBy(F.col("anchor_id").alias("vec_id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("ranked"))
        .select("vec_id", F.transform("ranked", lambda p: F.struct(p.vec_id.alias("vec_id"), p.score.alias("score"))).alias("positives"))
    )
    opened = stored(asked.join(best, "vec_id"), "anchor-positives")

    hard = met_in_blocks(single.select("*", nothing), opened, total).mapInArrow(
        lambda batches: _negatives(batches, n_negatives, low, high), FOUND_NEGATIVES)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return (
        hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))
    )


#: What ``op13_hard_negatives`` returns, over the view ``embeddings``.
MINE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
