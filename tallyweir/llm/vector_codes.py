"""Product codes of vectors by exact Lloyd rounds over partition-local cover trees.

Vectors of whole numbers are cut into equal parts; each part has a codebook. Rows are kept in blocks
with a cover tree for each part, built once and stored; a round sends the codebooks, a few hundred
entries whatever the data, to the blocks and gets counts and sums by entry back, added up in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm import cover_tree
from tallyweir.llm.common import release_memory, stored
from tallyweir.llm.vector_blocks import finite, matrix, whole

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Rows under one set of trees.
TREE_ROWS = 4096
# A difference of two components has one bit more than a component: two in its square.
SPARE_BITS = 2

FOREST = "vec_id array<bigint>, label array<bigint>, points binary, trees array<array<binary>>"
TOTALS = "part int, entry int, place int, total bigint, n bigint"
CODED = "vec_id bigint, label bigint, code string, error bigint"


class Codebooks(NamedTuple):
    """An integer matrix for each part, in order of the parts."""

    parts: list[np.ndarray]

    def sha256(self) -> str:
        """Hex digest of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for x in part.ravel().tolist()).encode()).hexdigest()


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(vectors, parts, axis=1)]


def _planted(batches: Iterator[pa.RecordBatch], dims: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = -(-batch.num_rows // TREE_ROWS)
        for piece in range(pieces):
            at = batch.num_rows * piece // pieces
            rows = batch.slice(at, batch.num_rows * (piece + 1) // pieces - at)
            vectors = matrix(rows.column("vector"), dims)
            yield pa.RecordBatch.from_arrays([
                pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([rows.column("label").to_pylist()], pa.list_(pa.int64())),
                pa.array([vectors.astype(np.int32).tobytes()], pa.binary()),
                pa.array([[cover_tree.build(p).packed() for p in _cut(vectors, parts)]], pa.list_(pa.list_(pa.binary()))),
            ], names=["vec_id", "label", "points", "trees"])
    release_memory()


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[list, list, list[tuple[np.ndarray, cover_tree.Tree]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = (batch.column(n)[i].as_py() for n in ("vec_id", "label"))
            points = np.frombuffer(batch.column("points")[i].as_buffer(), np.int32).astype(np.int64).reshape(len(ids), -1)
            trees = [cover_tree.Tree.unpacked(t) for t in batch.column("trees")[i].as_py()]
            yield ids, labels, list(zip(_cut(points, parts), trees, strict=True))


def _totals(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's counts and sums, one row for each component of an entry that got rows."""
    counts = [np.zeros(len(b), np.int64) for b in books]
    sums = [np.zeros(b.shape, np.int64) for b in books]
    for _, _, block in _blocks(batches, len(books)):
        for part, (points, tree) in enumerate(block):
            n, total = cover_tree.totals(points, tree, cover_tree.assign(points, tree, books[part]), len(books[part]))
            counts[part] += n
            sums[part] += total
    for part, (n, total) in enumerate(zip(counts, sums, strict=True)):
        entry, place = (x.ravel() for x in np.indices(total.shape))
        used = n[entry] > 0
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(used.sum(), part, np.int32)), pa.array(entry[used].astype(np.int32)),
            pa.array(place[used].astype(np.int32)), pa.array(total.ravel()[used]), pa.array(n[entry[used]]),
        ], names=["part", "entry", "place", "total", "n"])
    release_memory()


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for ids, labels, block in _blocks(batches, len(books)):
        error = np.zeros(len(ids), np.int64)
        entries = []
        for part, (points, tree) in enumerate(block):
            entry = cover_tree.labels(tree, cover_tree.assign(points, tree, books[part]))
            entries.append(entry.tolist())
            error += ((points - books[part][entry]) ** 2).sum(axis=1)
        codes = ["".join(f"{e:02x}" for e in own) for own in zip(*entries, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(codes, pa.string()), pa.array(error)],
            names=["vec_id", "label", "code", "error"],
        )
    release_memory()


class Forest(NamedTuple):
    """Stored blocks of rows with their trees, and the codebooks to start from."""

    blocks: DataFrame
    start: Codebooks


def plant(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Forest:
    """Trees over the usable rows of ``rows`` (vec_id, label, embedding).

    The codebooks start as the parts of the ``entries`` rows of smallest id (nulls last; of a repeated
    id the smaller vector first). The length of the vectors is that of the first such row which the
    parts divide; rows of another length, and those whose embedding is null or holds a null or
    non-finite component, are dropped.
    """
    usable = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    usable = usable.where(finite(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    usable = usable.select("vec_id", "label", whole(F.col("embedding"), scale, SPARE_BITS).alias("vector"))
    in_order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = usable.orderBy(*in_order).limit(1).collect()
    dims = len(first[0].vector) if first else parts
    usable = usable.where(F.size("vector") == dims)
    least = usable.orderBy(*in_order).limit(entries).collect()
    start = np.array([r.vector for r in least], np.int64).reshape(-1, dims)
    planted = usable.mapInArrow(lambda batches: _planted(batches, dims, parts), FOREST)
    return Forest(stored(planted, "cover-trees"), Codebooks(_cut(start, parts)))


def refine(forest: Forest, rounds: int = ROUNDS) -> Codebooks:
    """Lloyd rounds: each entry becomes the floor of the mean of the parts nearest to it; unused ones stay."""
    books = forest.start.parts
    for _ in range(rounds):
        own = books
        found = (
            forest.blocks.mapInArrow(lambda batches: _totals(batches, own), TOTALS)  # noqa: B023
            .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        )
        books = [b.copy() for b in books]
        # Components of the codebooks: as many rows at any size.
        for r in found.collect():
            books[r.part][r.entry, r.place] = r.total // r.n
    return Codebooks(books)


def encode(forest: Forest, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of every row under the trees: entry numbers in hex, and the squared distance."""
    return forest.blocks.mapInArrow(lambda batches: _coded(batches, books.parts), CODED)


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``coded`` with the approximate ``embedding`` that the codes stand for, as doubles; null codes give null."""
    names = list(coded.columns)

    def approximate(batches):
        for batch in batches:
            vectors = [
                None if code is None else
                (np.concatenate([b[int(code[2 * i : 2 * i + 2], 16)] for i, b in enumerate(books.parts)]) / scale).tolist()
                for code in batch.column("code").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*names, "embedding"])

    schema = ", ".join(f"`{n}` {t}" for n, t in coded.dtypes)
    return coded.mapInArrow(approximate, f"{schema}, embedding array<double>")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row of ``rows``.

    ``label_error`` is the error summed over the rows of the same label, nulls together. Repeated rows
    come back each; copies cost one comparison a block. Fewer rows than ``entries`` make shorter codebooks,
    and an empty table gives no rows. At most 256 entries, since a code has two hex digits a part. What
    counts as usable: ``plant``. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    forest = plant(rows, parts, entries, scale)
    books = refine(forest, rounds)
    coded = stored(encode(forest, books), "vector-codes")
    # Written first: the join then has an exchange of its own on either side, so that a hot label can be split.
    by_label = stored(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def _round_sql(name: str, books: str) -> str:
    """Assignments to the codebooks of the view ``books``, and the codebooks after them."""
    return f"""
{name}_a AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.r, p.part, c.entry,
           CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN {books} c USING (part))
  GROUP BY r, part
), {name} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.v, c.v) AS v FROM {books} c LEFT JOIN (
    SELECT part, entry, list(m ORDER BY place) AS v FROM (
      SELECT part, entry, place,
             CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM (SELECT part, entry, unnest(range(1, len(v) + 1)) AS place, unnest(v) AS x FROM p JOIN {name}_a USING (r, part))
      GROUP BY part, entry, place)
    GROUP BY part, entry) n USING (part, entry)
)"""


#: What ``op11_vector_codes`` returns, over the view ``embeddings`` with ids that don't repeat.
COMPRESS_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v
  FROM k CROSS JOIN (SELECT unnest(range({PARTS})) AS part)
), c0 AS MATERIALIZED (SELECT part, r AS entry, v FROM p WHERE r < {ENTRIES}
), {", ".join(_round_sql(f"c{i + 1}", f"c{i}") for i in range(ROUNDS))}
, {_round_sql("last", f"c{ROUNDS}")}
, e AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last_a GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM k JOIN e USING (r)
"""
