"""Packing of tokens into sequences by deficit round-robin over the sources' queues.

Every source is a queue of documents. In each window, a sequence, a queue is owed tokens in proportion
to its target; it is served in turn what it is owed, and what it is not served, or served too much,
stays as its deficit for the next window. A queue whose deficit is less than a worthwhile piece waits.

Queues are cut at the same points of virtual time, the share of its tokens that a queue should have
had, into segments of about as many tokens. A segment's windows are filled by one task; what a queue
is owed at a segment's start follows from the cut, so that deficits carry over without one task
waiting for another. Sequences run on across segments.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm.bpe import byte_letters
from tallyweir.llm.common import release_memory, slices, stored

LENGTH = 2048
END_ID = 1
# A queue is served once it is owed so many tokens, or all that it has left.
LEAST_PIECE = 128
# Tokens of a segment, which a task holds: a fraction of its share at small sizes, a million at large ones.
SEGMENT_TOKENS = 1 << 20
SEGMENTS_A_PARTITION = 2
SLICE_BYTES = 2 << 20
ID_BYTES = 4
# Segments whose token counts are added up in one place: the first of two levels of running sums.
SEGMENTS_A_GROUP = 1024

TOKENISED = "doc_id bigint, source string, chunk int, before bigint, doc_tokens bigint, ids binary"
PIECES = "segment bigint, source string, at bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary, carried double"
PACKED = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Encoder:
    """Token ids of texts, as the vocabulary file's own library gives them.

    The table of a byte-level vocabulary whose merges are in order of their tokens' ids is all that the
    faster of the two libraries needs; it refuses texts with very long runs of white space, and then, or
    with any other vocabulary, the vocabulary file's own library encodes.
    """

    def __init__(self, definition: str):
        self.definition = definition
        parsed = json.loads(definition)
        model = parsed["model"]
        self.own = None
        self.fast = None
        letters = byte_letters()
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", [])]
        steps = parsed.get("pre_tokenizer") or {}
        if (parsed.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex", True)
                and not steps.get("add_prefix_space") and all(a < b for a, b in pairwise(merged))
                and all(c in letters for token in model["vocab"] for c in token if token not in self._special(parsed))):
            import public_tokenizers
            import tiktoken

            special = self._special(parsed)
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _special(parsed: dict) -> dict[str, int]:
        return {t["content"]: t["id"] for t in parsed["added_tokens"]}

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:
                pass
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_str(self.definition)
            self.own.no_truncation()
            self.own.no_padding()
        return self.own.encode(text, add_special_tokens=False).ids


def highest_id(definition: str) -> int:
    parsed = json.loads(definition)
    return max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])])


@lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(definition)


def _tokenised(batches: Iterator[pa.RecordBatch], definition: str, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Every text's ids, and how many tokens of its source lie before it in this task's chunk of rows."""
    encode = encoder(definition).encode
    chunk = TaskContext.get().partitionId()
    queued: dict[str | None, int] = {}
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            ids, before, tokens = [], [], []
            for source, text in zip(rows.column("source").to_pylist(), rows.column("text").to_pylist(), strict=True):
                own = [*encode(text), end_id] if text else [end_id]
                ids.append(np.array(own, kind).tobytes())
                tokens.append(len(own))
                before.append(queued.get(source, 0))
                queued[source] = before[-1] + len(own)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("source"), pa.array(np.full(rows.num_rows, chunk, np.int32)),
                pa.array(before, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()),
            ], names=["doc_id", "source", "chunk", "before", "doc_tokens", "ids"])
    release_memory()


class Clock(NamedTuple):
    """Virtual time, between the points at which a queue with a target ends; segments don't reach across one."""

    times: list[float]
    firsts: list[int]  # the first segment from each point on

    @classmethod
    def of(cls, tokens: list[int], times: list[float], segment: int) -> Clock:
        """From the tokens that all queues together have had at each point, in segments of about so many."""
        firsts = [0]
        for a, b in pairwise(tokens):
            firsts.append(firsts[-1] + max(1, round((b - a) / segment)))
        return cls(times, firsts)

    def segments(self) -> int:
        return self.firsts[-1]

    def at(self, segment: int) -> float:
        """Virtual time of a segment's start."""
        return float(np.interp(segment, self.firsts, self.times))

    def queued(self, segment: int, begin: float, weight: float, tokens: int) -> int:
        """Tokens of a queue before the segment: those whose middle comes before its start."""
        if segment >= self.segments():
            return tokens
        return min(tokens, max(0, math.ceil((self.at(segment) - begin) * weight - 0.5)))

    def carried(self, segment: int, begin: float, weight: float, tokens: int) -> float:
        """What a queue is owed when the segment begins: between a half token too many and too few."""
        owed = min(float(tokens), max(0.0, (self.at(segment) - begin) * weight))
        return owed - self.queued(segment, begin, weight, tokens)

    def holding(self, place: int, begin: float, weight: float, tokens: int) -> int:
        """The segment that a queue's token lies in."""
        guess = int(np.interp(begin + (place + 0.5) / weight, self.times, self.firsts))
        guess = min(max(guess, 0), self.segments() - 1)
        while guess and self.queued(guess, begin, weight, tokens) > place:
            guess -= 1
        while self.queued(guess + 1, begin, weight, tokens) <= place:
            guess += 1
        return guess


def _ranges(row: dict, clock: Clock) -> Iterator[tuple[int, int, int]]:
    """A document's tokens by segment: segment, and from where to where in the queue."""
    at, end = row["offset"] + row["before"], row["offset"] + row["before"] + row["doc_tokens"]
    own = row["begin"], row["weight"], row["queue_tokens"]
    segment = clock.holding(at, *own)
    while at < end:
        stop = min(end, clock.queued(segment + 1, *own))
        if stop > at:
            yield segment, at, stop
            at = stop
        segment += 1


def _counted(batches: Iterator[pa.RecordBatch], clock: Clock) -> Iterator[pa.RecordBatch]:
    """Tokens by segment, of all rows of the task."""
    tokens: dict[int, int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            for segment, at, stop in _ranges(row, clock):
                tokens[segment] = tokens.get(segment, 0) + stop - at
    yield pa.RecordBatch.from_arrays([pa.array(tokens.keys(), pa.int64()), pa.array(tokens.values(), pa.int64())], names=["segment", "tokens"])


def _pieces(batches: Iterator[pa.RecordBatch], clock: Clock, width: int) -> Iterator[pa.RecordBatch]:
    names = [n.split()[0] for n in PIECES.split(", ")]
    for batch in batches:
        for rows in slices(batch, "ids", SLICE_BYTES):
            found: list[list] = [[] for _ in names]
            for row in rows.to_pylist():
                begins = row["offset"] + row["before"]
                for segment, at, stop in _ranges(row, clock):
                    carried = clock.carried(segment, row["begin"], row["weight"], row["queue_tokens"])
                    ids = row["ids"][(at - begins) * width : (stop - begins) * width]
                    values = (segment, row["source"], at, row["doc_id"], at - begins, row["doc_tokens"], ids, carried)
                    for column, value in zip(found, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=names)
    release_memory()


class Sequences(NamedTuple):
    """Places of all tokens: whole sequences, and the rest in sequences of powers of two, which need no padding."""

    total: int
    length: int

    def place(self, position: int) -> tuple[int, int, int]:
        """Sequence, offset in it, and tokens up to its end."""
        whole, rest = divmod(self.total, self.length)
        if position < whole * self.length:
            offset = position % self.length
            return position // self.length, offset, self.length - offset
        sequence, offset, size = whole, position - whole * self.length, self.length
        while True:
            size //= 2
            if rest & size:
                if offset < size:
                    return sequence, offset, size - offset
                sequence, offset = sequence + 1, offset - size


class _Queue:
    """Pieces of a source in a segment: (doc_id, start, doc_tokens, ids as an array)."""

    def __init__(self, carried: float):
        self.carried = carried
        self.pieces: list[tuple[int, int, int, np.ndarray]] = []
        self.tokens = 0
        self.served = 0
        self.head = 0
        self.taken = 0

    def left(self) -> int:
        return self.tokens - self.served

    def take(self, n: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """The next ``n`` tokens, cut where documents end."""
        self.served += n
        while n:
            doc, start, size, ids = self.pieces[self.head]
            part = ids[self.taken : self.taken + n]
            yield doc, start + self.taken, size, part
            n -= len(part)
            self.taken += len(part)
            if self.taken == len(ids):
                self.pieces[self.head] = None
                self.head += 1
                self.taken = 0


def fill(queues: list[_Queue], position: int, sequences: Sequences, least: int) -> Iterator[tuple]:
    """Pieces in order of their place: (doc_id, start, doc_tokens, ids, sequence, offset).

    Window by window, those queues whose deficit by the window's end is worth a piece are served what
    they are owed, the longest waiting first; room that is left goes to those that would be next.
    """
    begin, total = position, sum(q.tokens for q in queues)
    end = begin + total

    def due(q: _Queue) -> float:
        """The place at which the queue is owed a worthwhile piece."""
        return begin + (q.served + min(least, q.left()) - q.carried) * total / q.tokens

    waiting = [(due(q), i) for i, q in enumerate(queues) if q.tokens]
    heapq.heapify(waiting)
    while position < end:
        sequence, offset, room = sequences.place(position)
        room = min(room, end - position)
        window_end = position + room
        while room:
            when, i = heapq.heappop(waiting)
            q = queues[i]
            owed = q.carried + q.tokens * (window_end - begin) / total - q.served
            n = min(room, q.left(), max(int(owed), min(least, q.left())))
            for doc, start, size, ids in q.take(n):
                yield doc, start, size, ids, sequence, offset
                offset += len(ids)
            room -= n
            if q.left():
                heapq.heappush(waiting, (due(q), i))
        position = window_end


def _packed(batches: Iterator[pa.RecordBatch], sequences: Sequences, least: int, kind: str) -> Iterator[pa.RecordBatch]:
    number, position, queues = None, 0, {}

    def filled() -> pa.RecordBatch:
        rows = list(fill(list(queues.values()), position, sequences, least))
        ints = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1, 2, 4, 5)]
        lengths = pa.array([len(r[3]) for r in rows], pa.int64())
        ids = pa.array([r[3].astype("<u4").tobytes() for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays(
            [ints[0], ints[1], lengths, ints[2], ints[3], ints[4], ids], names=[n.split()[0] for n in PACKED.split(", ")]
        )

    for batch in batches:
        for row in batch.to_pylist():
            if row["segment"] != number:
                if queues:
                    yield filled()
                number, queues = row["segment"], {}
            if row["ids"] is None:
                position = row["at"]
                continue
            queue = queues.get(row["source"])
            if queue is None:
                queue = queues[row["source"]] = _Queue(row["carried"])
            queue.pieces.append((row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], kind)))
            queue.tokens += row["doc_tokens_here"]
    if queues:
        yield filled()
    release_memory()


def _clock(totals: DataFrame, total: int, targets: Mapping[str, float] | None, parts: int) -> tuple[Clock, float]:
    """The clock, and the time at which queues without a target begin."""
    segment = max(LENGTH, min(SEGMENT_TOKENS, total // (parts * SEGMENTS_A_PARTITION)))
    if not targets:
        return Clock.of([0, total], [0.0, 1.0], segment), 0.0
    # A row for each target at most.
    aimed = {r.source: r.queue_tokens for r in totals.where(F.col("source").isin(list(targets))).collect()}
    ends = {s: n / targets[s] for s, n in aimed.items()}
    last = max(ends.values(), default=0.0)
    times = sorted({0.0, *ends.values()})
    tokens = [sum(min(n, targets[s] * t) for s, n in aimed.items()) for t in times]
    return Clock.of([*tokens, total], [*times, last + 1], segment), last


def pack(docs: DataFrame, vocabulary_path: str, targets: Mapping[str, float] | None = None, length: int = LENGTH,
         end_id: int = END_ID, least: int = LEAST_PIECE) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: the pieces of all documents (doc_id, source, text).

    A document's tokens are its text's and then ``end_id``; ``ids`` are the piece's, as little-endian
    unsigned 32-bit integers. Each token lies in one piece, and each sequence holds ``length`` tokens,
    but the last ones, whose lengths are the powers of two that make up the rest: nothing is padded.
    ``length`` is a power of two.

    ``targets`` are the sources' proportions (above zero); without any, a source's own share of all tokens.
    Up to the end of any window a source has had its proportion to within about ``least`` tokens, as long as
    it lasts; one that ends leaves its share to the others, and sources without a target follow when all
    others ended.

    A null or empty text has the end token alone, a null source is a queue of its own, texts of any
    length are encoded whole and cut, repeated rows are packed each, and an empty table gives no rows.
    Other columns are ignored.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    if targets and min(targets.values()) <= 0:
        raise ValueError("targets must be above zero")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(vocabulary_path, encoding="utf-8") as file:
        definition = file.read()
    sent = spark.sparkContext.broadcast(definition)
    kind = "<u2" if max(highest_id(definition), end_id) < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    tokenised = stored(given.mapInArrow(lambda b: _tokenised(b, sent.value, end_id, kind), TOKENISED), "tokens")

    # A source's chunks, one for each task of the scan, follow one another in its queue.
    chunks = tokenised.groupBy("source", "chunk").agg(F.sum("doc_tokens").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(chunks.withColumn("offset", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))), "chunks")
    totals = placed.groupBy("source").agg(F.sum("tokens").alias("queue_tokens"))
    total = totals.agg(F.sum("queue_tokens")).first()[0] or 0
    clock, last = _clock(totals, total, targets, parts)
    natural = F.col("queue_tokens").cast("double")
    if targets:
        weights = F.create_map(*(F.lit(x) for s, w in targets.items() for x in (s, float(w))))
        weight = F.when(F.col("source").isNotNull(), F.try_element_at(weights, F.col("source")))
        totals = totals.select("*", F.coalesce(weight, natural).alias("weight"), F.when(weight.isNull(), last).otherwise(0.0).alias("begin"))
    else:
        totals = totals.select("*", natural.alias("weight"), F.lit(0.0).alias("begin"))
    totals = totals.withColumnRenamed("source", "of_source")
    queues = stored(
        placed.join(totals, F.col("source").eqNullSafe(F.col("of_source"))).select(
            F.col("source").alias("q_source"), F.col("chunk").alias("q_chunk"), "offset", "queue_tokens", "weight", "begin"), "queues")
    inside = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("chunk") == F.col("q_chunk"))
    queue = ("offset", "before", "doc_tokens", "begin", "weight", "queue_tokens")

    counted = (
        tokenised.select("source", "chunk", "before", "doc_tokens").join(queues, inside).select(*queue)
        .mapInArrow(lambda b: _counted(b, clock), "segment bigint, tokens bigint")
        .groupBy("segment").agg(F.sum("tokens").alias("tokens")).withColumn("group", F.floor(F.col("segment") / SEGMENTS_A_GROUP))
    )
    before_it = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counted.groupBy("group").agg(F.sum("tokens").alias("of_group")).select(
        "group", F.coalesce(F.sum("of_group").over(before_it), F.lit(0)).alias("group_start"))
    in_group = Window.partitionBy("group").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("inside", F.coalesce(F.sum("tokens").over(in_group), F.lit(0))).join(groups, "group").select(
        "segment", (F.col("group_start") + F.col("inside")).alias("at"))

    pieces = tokenised.join(queues, inside).select("doc_id", "source", "ids", *queue).mapInArrow(lambda b: _pieces(b, clock, width), PIECES)
    pieces = pieces.withColumn("doc_tokens_here", (F.octet_length("ids") / width).cast("bigint"))
    both = starts.unionByName(pieces, allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.col("segment").cast("int")).sortWithinPartitions(
        "segment", F.col("ids").isNotNull(), "source", F.col("at"))
    sequences = Sequences(total, length)
    return dealt.mapInArrow(lambda b: _packed(b, sequences, least, kind), PACKED)


def assemble(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the sequences of ``pack``, those that are no power of two padded to ``length``.

    A sequence has at most ``length`` pieces, so that it is brought together whatever the data.
    """
    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = b"".join(rows.column("ids").to_pylist())
        n = len(ids) // ID_BYTES
        padding = 0 if n & (n - 1) == 0 else length - n
        ids += pad_id.to_bytes(ID_BYTES, "little") * padding
        return pa.table({"sequence_id": rows.column("sequence_id")[:1], "n_tokens": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        joined, "sequence_id bigint, n_tokens bigint, ids binary")
