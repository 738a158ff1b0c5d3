"""Benchmark decontamination by Wu-Manber search for the benchmark's word windows.

Texts become words joined by single spaces, and every window a byte string with a space on either
side. Windows of similar length share one search: a shift table over blocks of bytes skips positions
where no window can end, buckets by the hash of a window's last block select the windows to test,
and bytes are compared. Many cursors go through a slice of texts side by side, each by its own
shifts, so that the search is array arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import flat_bytes, lower_bytes, slices

WINDOW = 10
# Bytes of windows sent to the executors at once; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
# Lower bounds of the length classes; each class has its own tables.
LENGTHS = (3, 6, 12, 24, 48, 96)
CURSOR_BYTES = 2048
SPACE, LINE = 32, 10

WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_bytes() -> np.ndarray:
    """Byte to lower-cased byte of a word, or to 0 between words."""
    mapped = lower_bytes()
    between = np.ones(256, bool)
    for low, high in ((48, 57), (97, 122), (128, 255)):
        between[low : high + 1] = False
    mapped[between[mapped]] = 0
    return mapped


class Words(NamedTuple):
    """Texts as `` word word \\n`` each: the bytes, each text's end, and where words start."""

    text: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


def normalised(texts: pa.Array, mapped: np.ndarray) -> Words:
    flat, offsets = flat_bytes(texts)
    count = len(offsets) - 1
    low = mapped[flat]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(flat)]
    first[begins] = inside[begins]
    sizes = np.diff(offsets)
    # One space before each word; a space and a line end after each text.
    place = np.cumsum(inside, dtype=np.int32) + np.cumsum(first, dtype=np.int32) - 1
    place += np.repeat(np.arange(count, dtype=np.int32) * 2, sizes)
    gained = np.concatenate(([0], np.cumsum(inside, dtype=np.int64) + np.cumsum(first, dtype=np.int64)))[offsets[1:]]
    ends = gained + 2 * np.arange(1, count + 1)
    text = np.full(int(ends[-1]) if count else 0, SPACE, np.uint8)
    text[place[inside]] = low[inside]
    text[ends - 1] = LINE
    return Words(text, ends, place[first].astype(np.int64))


class WuManber:
    """Occurrences of byte strings of at least ``shortest`` bytes."""

    def __init__(self, patterns: list[bytes], ids: np.ndarray):
        self.patterns, self.ids = patterns, ids
        self.shortest = min(map(len, patterns))
        self.block = min(8, max(2, self.shortest // 3))
        self.bits = int(np.clip(np.ceil(np.log2(len(patterns) * self.shortest * 4)), 10, 22))
        heads = np.frombuffer(b"".join(p[: self.shortest] for p in patterns), np.uint8).reshape(len(patterns), -1)
        farthest = self.shortest - self.block + 1
        shift = np.full(1 << self.bits, farthest, np.int32)
        for end in range(self.block - 1, self.shortest):
            np.minimum.at(shift, self._hash(heads.reshape(-1), np.arange(len(patterns)) * self.shortest + end),
                          self.shortest - 1 - end)
        self.shift = shift
        last = self._hash(heads.reshape(-1), np.arange(1, len(patterns) + 1) * self.shortest - 1)
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))
        self.heads = heads

    def _hash(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = np.zeros(len(ends), np.uint64)
        for back in range(self.block):
            value = (value << np.uint64(8)) | text[ends - back]
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all occurrences, and which of the strings each is."""
        begin = np.arange(self.shortest - 1, len(text), CURSOR_BYTES)
        stop = np.minimum(begin + CURSOR_BYTES, len(text))
        ends = [np.zeros(0, np.int64)]
        while len(begin):
            shift = self.shift[self._hash(text, begin)]
            ends.append(begin[shift == 0])
            begin = begin + np.maximum(shift, 1)
            going = begin < stop
            begin, stop = begin[going], stop[going]
        return self._confirm(text, np.concatenate(ends))

    def _confirm(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = self._hash(text, ends)
        low, high = self.bucket[hashed], self.bucket[hashed + 1]
        found: list[tuple[int, int]] = []
        rank = 0
        while len(ends):
            which = self.order[low + rank] if len(low) else low
            near = np.ones(len(ends), bool)
            for at in range(0, self.shortest, max(1, self.shortest // 8)):
                near &= text[ends - (self.shortest - 1) + at] == self.heads[which, at]
            for end, pattern in zip(ends[near].tolist(), which[near].tolist(), strict=True):
                start = end - self.shortest + 1
                wanted = self.patterns[pattern]
                if text[start : start + len(wanted)].tobytes() == wanted:
                    found.append((start, pattern))
            rank += 1
            going = low + rank < high
            ends, low, high = ends[going], low[going], high[going]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


class Windows(NamedTuple):
    """Distinct windows as byte strings, and the ids of the items each occurs in."""

    patterns: list[bytes]
    items: list[list[int]]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: (needle, items). Items without words have none."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(WORD_CHARS), F.lit(0))
    last = F.greatest(F.size("words") - window + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice("words", i, window)))
    return (
        benchmark.select("item_id", words.alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", F.explode(cut).alias("words"))
        .groupBy(F.concat(F.lit(" "), "words", F.lit(" ")).alias("needle"))
        .agg(F.collect_set("item_id").alias("items"))
    )


def searches(patterns: list[bytes]) -> list[WuManber]:
    """One search per length class that has windows."""
    sizes = np.array([len(p) for p in patterns])
    classes = np.searchsorted(LENGTHS, sizes, side="right")
    return [
        WuManber([patterns[i] for i in ids.tolist()], ids)
        for ids in (np.flatnonzero(classes == k) for k in np.unique(classes))
    ]


def _marked(batches: Iterator[pa.RecordBatch], patterns: list[bytes], items: list[list[int]],
            schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    finders, mapped = searches(patterns), word_bytes()
    sizes = np.array([len(p) for p in patterns])
    for batch in batches:
        for part in slices(batch, "text"):
            words = normalised(part.column("text"), mapped)
            starts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for finder in finders:
                at, which = finder.find(words.text)
                starts.append(at)
                ids.append(finder.ids[which])
            at, which = np.concatenate(starts), np.concatenate(ids)
            # A word is hit if it starts after an occurrence's start and before its last space.
            first = np.searchsorted(words.starts, at, side="left")
            last = np.searchsorted(words.starts, at + sizes[which] - 1, side="left")
            row = np.searchsorted(words.ends, at, side="right")
            bounds = np.searchsorted(words.starts, words.ends, side="left")
            begins = np.concatenate(([0], bounds[:-1]))
            spans = [set() for _ in range(part.num_rows)]
            hit_items = [set() for _ in range(part.num_rows)]
            for r, a, b, w in zip(row.tolist(), first.tolist(), last.tolist(), which.tolist(), strict=True):
                spans[r].add((a - int(begins[r]), b - int(begins[r])))
                hit_items[r].update(items[w])
            old_spans, old_items = part.column("spans").to_pylist(), part.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([
                *(part.column(name) for name in schema.names[:-3]),
                pa.array(bounds - begins, pa.int64()),
                pa.array([[x for s in _merged(spans[r] | _pairs(old_spans[r])) for x in s] for r in range(part.num_rows)], pa.list_(pa.int32())),
                pa.array([sorted(hit_items[r] | set(old_items[r])) for r in range(part.num_rows)], pa.list_(pa.int64())),
            ], schema=schema)


def _pairs(flat: list[int]) -> set[tuple[int, int]]:
    return set(zip(flat[::2], flat[1::2], strict=True))


def _merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, *carry, n_words, spans, items`` of every row of ``docs``.

    ``spans`` lists the maximal runs of hit words as start, end, start, end, ... (word numbers from 0,
    end exclusive); ``items`` the ids of the benchmark items with occurring windows. A null or empty
    text has no words and no hits; a long text is searched whole; each repeated row is judged by
    itself. Windows of items without an id hit words but name no item; an empty benchmark hits
    nothing. Other columns are ignored unless carried.

    The windows are dealt into blocks of about ``block_bytes``, and the documents are searched once
    per block, so what is broadcast at a time keeps that bound.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", "text", *carry, F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("spans"), F.array().cast("array<bigint>").alias("items"),
    )
    schema = rows.schema
    windows = benchmark_windows(benchmark, window)
    total = windows.agg(F.sum(F.octet_length("needle") + 8 * F.size("items"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(max(1, blocks)):
        dealt = windows.where(F.pmod(F.xxhash64("needle"), F.lit(max(1, blocks))) == block).collect()
        sent = spark.sparkContext.broadcast(Windows([r.needle.encode() for r in dealt], [r["items"] for r in dealt]))

        def search(batches, sent=sent):
            from pyspark.sql.pandas.types import to_arrow_schema
            found = sent.value
            return _marked(batches, found.patterns, found.items, to_arrow_schema(schema))

        rows = rows.mapInArrow(search, schema)
    return rows


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``."""
    ends = F.filter("spans", lambda x, i: i % 2 == 1)
    starts = F.filter("spans", lambda x, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return (
        mark_contamination(docs, benchmark, **options)
        .select("doc_id", "n_words", (total(ends) - total(starts)).alias("n_hit"),
                F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns.

    Null and empty texts have no word and stay, repeated rows are judged each, a text is searched whole, and
    without benchmark items all rows stay. Columns of any name beside ``doc_id`` and ``text`` are carried along.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("rest") if rest else F.struct(F.lit(0)).alias("rest"))
    clean = mark_contamination(packed, benchmark, carry=("rest",), **options).where(F.size("spans") == 0)
    kept = {c: F.col(f"rest.`{c}`") if c in rest else F.col(c) for c in docs.columns}
    return clean.select(*(column.alias(name) for name, column in kept.items()))


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
