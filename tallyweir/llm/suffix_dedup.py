"""Removal of byte strings that repeat across documents, by suffix arrays of shards.

1. *Anchors*. Of the byte grams in a window of ``length`` bytes the one with the least hash is the
   window's anchor, so equal windows have equal anchors. Anchors found in one text only cannot belong
   to a repeated window; the others' windows are cut out as fragments.
2. *Shards*. A fragment goes to the shard of its anchor, so equal windows meet there. Equal fragments
   are merged within a task before they are sent, and again in the shard: however many documents
   hold a passage, one copy is sorted.
3. *Induced sorting* (``suffix_sort``) of a shard's distinct fragments, those that by the hashes of
   their windows meet another one: neighbours in the suffix array with a common prefix of ``length``
   bytes are the same window, and of its documents all but the smallest lose it.

Texts, requests and results are grouped by ``part``, a hash of the document, of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import flat_bytes, release_memory, slices, stored
from tallyweir.llm.shingles import forget_powers, mixed, powers
from tallyweir.llm.suffix_sort import DEPTH, sort_suffixes

LENGTH = 50
GRAM = 16
# Bytes of text behind a part, a shard of anchors and a shard of fragments, on average.
PART_BYTES = 8 << 20
ANCHOR_BYTES = 24 << 20
SHARD_BYTES = 6 << 20
# Anchors a task gathers before it sends them to the shards.
GATHERED = 1 << 18
# Bytes of text that are hashed at once; a longer text is taken in pieces. Arrays take a hundred times that.
SLICE_BYTES = 1 << 18

DIGEST = 16
HASH_BYTES = 6

ANCHORS = "shard int, hashes binary, counts binary, starts binary, runs binary, parts binary, docs binary, digests binary"
REQUESTS = "part int, hashes binary, starts binary, runs binary, docs binary, digests binary, counts binary"
PIECES = "shard int, part int, blob binary, sizes binary, docs binary, numbers binary, starts binary, found boolean"
SPANS = "part int, numbers binary, starts binary, sizes binary, copy_id bigint, copy_digest binary"


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return wide.reshape(-1).view("<u8")


def _planes(values: np.ndarray, kind: str) -> bytes:
    """All lowest bytes first, then the next: high bytes, mostly zero, cost nothing once compressed."""
    wide = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return np.ascontiguousarray(wide.T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class _Runs(NamedTuple):
    """Runs of windows with one anchor: its hash, the row, the first window and how many."""

    hashes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray


def anchor_runs(flat: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> _Runs:
    """The runs of all rows' windows; a run that crosses the border of two pieces is two runs."""
    found = [_piece_runs(flat, offsets, at, length, gram) for at in range(0, max(1, len(flat) - length + 1), SLICE_BYTES)]
    return _Runs(*map(np.concatenate, zip(*found, strict=True)))


def _piece_runs(whole: np.ndarray, ends: np.ndarray, begin: int, length: int, gram: int) -> _Runs:
    """Runs of the windows that start in the ``SLICE_BYTES`` from ``begin`` on."""
    flat = whole[begin : begin + SLICE_BYTES + length - 1]
    offsets = np.clip(ends - begin, 0, len(flat))
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < length:
        return _Runs(none.astype(np.uint64), none, none, none)
    up, down = powers(n + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n])))
    hashes = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    # Least hash, then leftmost: what a window's anchor is depends on the window alone.
    low = np.uint64((1 << 32) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[1:][row]
    anchor, row, at = anchor[valid], row[valid], np.flatnonzero(valid)
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(anchor)))
    return _Runs(hashes[anchor[starts]] >> np.uint64(16), row[starts], at[starts] + begin - ends[row[starts]], counts)


def _anchored(batches: Iterator[pa.RecordBatch], shards: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each distinct text of the task, by shard."""
    met: dict[bytes, int] = {}
    held: list[tuple[_Runs, list, list, list]] = []
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        base, rows = 0, []
        for runs, _, _, _ in held:
            rows.append(runs.row + base)
            base += len(held[len(rows) - 1][1])
        hashes, row = np.concatenate([h[0].hashes for h in held]), np.concatenate(rows)
        starts, counts = (np.concatenate([getattr(h[0], f) for h in held]) for f in ("start", "count"))
        parts, docs, digests = ([x for h in held for x in h[i]] for i in (1, 2, 3))
        shard = (hashes % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.unique(shard).tolist():
            own = order[bounds[s] : bounds[s + 1]]
            per_doc = np.bincount(row[own], minlength=base)
            used = np.flatnonzero(per_doc)
            yield pa.RecordBatch.from_pylist([{
                "shard": s, "hashes": _packed(hashes[own]), "counts": _planes(per_doc[used], "<u4"),
                "starts": _planes(starts[own], "<u4"), "runs": counts[own].astype("<u1").tobytes(),
                "parts": _planes(np.array(parts)[used], "<i4"), "docs": _planes(np.array(docs)[used], "<i8"),
                "digests": b"".join(digests[u] for u in used.tolist()),
            }], schema=_arrow(ANCHORS))

    for batch in batches:
        for rows in slices(batch, "body", SLICE_BYTES):
            parts, docs, digests = (rows.column(c).to_pylist() for c in ("part", "doc_id", "digest"))
            # A text that repeats in the task counts with its smallest document.
            wanted = []
            for i, (doc, digest) in enumerate(zip(docs, digests, strict=True)):
                if doc is not None and doc < met.get(digest, doc + 1):
                    met[digest] = doc
                    wanted.append(i)
            chosen = rows.take(pa.array(wanted, pa.int64()))
            flat, offsets = flat_bytes(chosen.column("body"))
            runs = anchor_runs(flat, offsets, length, gram)
            held.append((runs, *([x[i] for i in wanted] for x in (parts, docs, digests))))
            size += len(runs.hashes)
            if size >= GATHERED:
                yield from sent()
                held, size = [], 0
    if size:
        yield from sent()
    forget_powers()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split(" ") for field in ddl.split(", "))])


def _repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shard the anchors that several texts have, for each part; a text stands for all its copies."""
    columns: dict[str, list] = {n: [] for n in ("hashes", "owner", "starts", "runs", "parts", "docs", "digests")}
    owners = 0
    for batch in batches:
        for r in batch.to_pylist():
            counts = _from_planes(r["counts"], "<u4")
            columns["hashes"].append(_unpacked(r["hashes"]))
            columns["owner"].append(np.repeat(np.arange(owners, owners + len(counts), dtype=np.int32), counts))
            owners += len(counts)
            for name, kind in (("starts", "<u4"), ("runs", "<u1"), ("parts", "<i4"), ("docs", "<i8"), ("digests", f"V{DIGEST}")):
                flat = name in ("runs", "digests")
                columns[name].append(np.frombuffer(r[name], kind) if flat else _from_planes(r[name], kind))
    joined = {n: np.concatenate(v) for n, v in columns.items()}
    _, text = np.unique(joined["digests"], return_inverse=True)
    by = np.lexsort((joined["docs"], text))
    first = np.append(True, text[by][1:] != text[by][:-1])
    stands = np.zeros(owners, bool)
    stands[by[first]] = True
    kept = np.flatnonzero(stands[joined["owner"]])
    kept = kept[np.argsort(joined["hashes"][kept], kind="stable")]
    hashes, owner = joined["hashes"][kept], joined["owner"][kept]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    if not len(starts):
        return
    sizes = np.diff(np.append(starts, len(hashes)))
    other = text[owner] != np.repeat(text[owner][starts], sizes)
    several = np.repeat(np.logical_or.reduceat(other, starts), sizes)
    kept, owner, hashes = kept[several], owner[several], hashes[several]
    order = np.lexsort((joined["starts"][kept], owner, joined["parts"][owner]))
    kept, owner, hashes = kept[order], owner[order], hashes[order]
    part = joined["parts"][owner]
    for p in np.unique(part).tolist():
        a, b = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
        first = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
        owners = owner[a:b][first]
        yield pa.RecordBatch.from_pylist([{
            "part": p, "hashes": _packed(hashes[a:b]), "starts": _planes(joined["starts"][kept[a:b]], "<u4"),
            "runs": joined["runs"][kept[a:b]].tobytes(), "docs": _planes(joined["docs"][owners], "<i8"),
            "digests": joined["digests"][owners].tobytes(), "counts": _planes(np.diff(np.append(first, b - a)), "<u4"),
        }], schema=_arrow(REQUESTS))


def _numbered(texts: pa.Table) -> dict[tuple[int, bytes], int]:
    """Numbers of a part's texts, the same wherever the part is read."""
    keys = zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), strict=True)
    return {key: n for n, key in enumerate(sorted({k for k in keys if k[0] is not None}))}


def _fragments(texts: pa.Table, requests: pa.Table, shards: int, length: int) -> pa.Table:
    """The requested windows of one part's texts, equal ones merged; what the merging itself settles is marked found."""
    numbers, bodies = _numbered(texts), {}
    for doc, digest, body in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "digest", "body")), strict=True):
        bodies[doc, digest] = body
    part = requests.column("part")[0].as_py() if requests.num_rows else 0
    # Fragment: its shard, its smallest document, and where that has it: text number and start.
    merged: dict[bytes, tuple[int, int, list[int]]] = {}
    found: list[tuple[int, int, int]] = []
    for r in requests.to_pylist():
        starts, runs = _from_planes(r["starts"], "<u4").tolist(), np.frombuffer(r["runs"], "<u1").tolist()
        shard = (_unpacked(r["hashes"]) % np.uint64(shards)).tolist()
        docs, counts = _from_planes(r["docs"], "<i8").tolist(), _from_planes(r["counts"], "<u4").tolist()
        at = 0
        for i, (doc, count) in enumerate(zip(docs, counts, strict=True)):
            key = doc, r["digests"][i * DIGEST : (i + 1) * DIGEST]
            body, number = bodies[key], numbers[key]
            for k in range(at, at + count):
                start = starts[k]
                fragment = body[start : start + runs[k] - 1 + length]
                known = merged.get(fragment)
                if known is None or doc < known[1]:
                    if known is not None:
                        found += [(n, s, len(fragment)) for n, s in zip(known[2][::2], known[2][1::2], strict=True)]
                    merged[fragment] = (shard[k], doc, [number, start])
                elif doc > known[1]:
                    found.append((number, start, len(fragment)))
                else:
                    known[2].extend((number, start))
            at += count
    by_shard: dict[int, list] = {}
    for fragment, (shard, doc, places) in merged.items():
        own = by_shard.setdefault(shard, [])
        for n, s in zip(places[::2], places[1::2], strict=True):
            own.append((n, s, len(fragment), doc, fragment))
    merged.clear()
    release_memory()
    rows = [_piece(shard, part, own, False) for shard, own in by_shard.items()]
    if found:
        rows.append(_piece(part % shards, part, found, True))
    return pa.Table.from_pylist(rows, schema=_arrow(PIECES))


def _piece(shard: int, part: int, entries: list, found: bool) -> dict:
    column = lambda i: np.array([e[i] for e in entries])
    return {
        "shard": shard, "part": part, "blob": b"" if found else b"".join(e[4] for e in entries), "sizes": _planes(column(2), "<u4"),
        "docs": b"" if found else _planes(column(3), "<i8"), "numbers": _planes(column(0), "<u4"), "starts": _planes(column(1), "<u4"),
        "found": found,
    }


def _spans(part: np.ndarray, numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((starts, numbers, part))
    part, numbers, starts, sizes = (x[order] for x in (part, numbers, starts, sizes))
    for p in np.unique(part).tolist():
        a, b = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
        yield pa.RecordBatch.from_pylist([{
            "part": p, "numbers": _planes(numbers[a:b], "<u4"), "starts": _planes(starts[a:b], "<u4"), "sizes": _planes(sizes[a:b], "<u4"),
        }], schema=_arrow(SPANS))


def _settled(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from the suffix array of one shard's distinct fragments."""
    known: dict[bytes, int] = {}
    texts: list[bytes] = []
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for r in batch.to_pylist():
            number, start, size = (_from_planes(r[n], "<u4") for n in ("numbers", "starts", "sizes"))
            part = np.full(len(number), r["part"], np.int32)
            if r["found"]:
                yield from _spans(part, number, start, size)
                continue
            blob, at, own = r["blob"], 0, []
            for n in size.tolist():
                fragment = blob[at : at + n]
                at += n
                which = known.get(fragment)
                if which is None:
                    which = known[fragment] = len(texts)
                    texts.append(fragment)
                own.append(which)
            held.append((np.array(own, np.int32), part, _from_planes(r["docs"], "<i8"), number, start, size))
    known.clear()
    if not texts:
        return
    fragment_of, part, docs, numbers, starts, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, fragment_of, docs)
    # Copies of a fragment in later documents lose it whole; in its first document, the lost windows.
    whole = docs > least[fragment_of]
    yield from _spans(part[whole], numbers[whole], starts[whole], sizes[whole])
    fragment, first, run = _lost_windows(texts, least, length)
    begin, stop = np.searchsorted(fragment, fragment_of, "left"), np.searchsorted(fragment, fragment_of, "right")
    own = np.flatnonzero(~whole & (stop > begin))
    times = (stop - begin)[own]
    entry = np.repeat(own, times)
    which = np.repeat(begin[own] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    yield from _spans(part[entry], numbers[entry], starts[entry] + first[which], run[which] + length - 1)


def _meeting(texts: list[bytes], length: int) -> np.ndarray:
    """Numbers of the texts that have a window in common with another one.

    Windows are compared by hash, so a few more may come along, but none is missed. A key is a hash whose
    low bits are the text's number, so that one sort brings the texts of a window together.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    low = np.uint64((1 << max(1, len(texts).bit_length())) - 1)
    keys, at = [], 0
    while at < len(texts):
        base = ends[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        flat = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
        text = np.repeat(np.arange(at, stop), sizes[at:stop])
        start = np.flatnonzero(np.arange(len(flat)) + length <= ends[text] - base)
        up, down = powers(len(flat) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])))
        hashes = mixed((total[start + length] - total[start]) * down[start])
        keys.append((hashes & ~low) | text[start].astype(np.uint64))
        at = stop
    sorted_keys = np.sort(np.concatenate(keys))
    text, window = (sorted_keys & low).astype(np.int64), sorted_keys & ~low
    meet = np.flatnonzero((window[1:] == window[:-1]) & (text[1:] != text[:-1]))
    return np.unique(text[np.append(meet, meet + 1)])


def _lost_windows(texts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a fragment's first document loses to a smaller one: fragment, first window, count.

    Only fragments that meet another one in a window are sorted.
    """
    chosen = _meeting(texts, length)
    if not len(chosen):
        forget_powers()
        return (np.zeros(0, np.int64),) * 3
    texts, least = [texts[c] for c in chosen.tolist()], least[chosen]
    sizes = np.array([len(t) for t in texts], np.int64)
    # Letters from 2 on are bytes; 1 ends a fragment and 0 the text.
    letters = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1) - 1
    letters[ends] = 1
    letters[-1] = 0
    order = sort_suffixes(letters)
    fragment = np.minimum(np.searchsorted(ends, order.suffixes, side="left"), len(texts) - 1)
    offset = order.suffixes - (ends[fragment] - sizes[fragment])
    window = (offset + length <= sizes[fragment]) & (order.suffixes < ends[-1])
    # The common prefix with the window before, past the suffixes between that are no windows.
    at = np.flatnonzero(window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    same = np.minimum.reduceat(order.common[: at[-1] + 1], np.append(0, at[:-1] + 1))
    fragment, offset = fragment[window], offset[window]
    group = np.flatnonzero(np.append(True, same[1:] < length))
    smallest = np.repeat(np.minimum.reduceat(least[fragment], group), np.diff(np.append(group, len(fragment))))
    forget_powers()
    lost = smallest < least[fragment]
    fragment, offset = fragment[lost], offset[lost]
    by = np.lexsort((offset, fragment))
    fragment, offset = fragment[by], offset[by]
    first = np.flatnonzero(np.append(True, (fragment[1:] != fragment[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(fragment) else np.zeros(0, np.int64)
    return chosen[fragment[first]], offset[first], np.diff(np.append(first, len(fragment)))


def _trimmed(texts: pa.Table, spans: pa.Table, carried: list[str], as_text: bool) -> pa.Table:
    """Each text of a part without the bytes of its spans, and the maximal removed runs."""
    numbers = _numbered(texts)
    removed: dict[int, list] = {}
    copies: set[tuple[int, bytes]] = set()
    for r in spans.to_pylist():
        if r["copy_id"] is not None:
            copies.add((r["copy_id"], r["copy_digest"]))
            continue
        number, start, size = (_from_planes(r[n], "<u4").astype(np.int64) for n in ("numbers", "starts", "sizes"))
        new = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist()
        for a, b in zip(new, [*new[1:], len(number)], strict=True):
            removed.setdefault(int(number[a]), []).append((start[a:b], size[a:b]))
    kept, runs = [], []
    for doc, digest, body in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "digest", "body")), strict=True):
        if (doc, digest) in copies:
            kept.append(b"")
            runs.append([0, len(body)])
            continue
        found = removed.get(numbers.get((doc, digest), -1))
        if found is None:
            kept.append(body)
            runs.append([])
            continue
        start = np.concatenate([s for s, _ in found])
        stop = start + np.concatenate([n for _, n in found])
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.maximum.accumulate(stop[order])
        first = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
        a, b = start[first], stop[np.append(first[1:], len(stop)) - 1]
        pieces = zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True)
        kept.append(b"".join(body[x:y] for x, y in pieces))
        runs.append(np.column_stack((a, b)).ravel().tolist())
    columns = {c: texts.column(c) for c in carried}
    release_memory()
    return pa.table({**columns, "n_bytes": pa.array([len(b) for b in texts.column("body").to_pylist()], pa.int64()),
                     "kept": _column(kept, as_text), "spans": pa.array(runs, pa.list_(pa.int64()))})


def _column(kept: list[bytes], as_text: bool) -> pa.Array:
    return pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (),
                   part_bytes: int = PART_BYTES, anchor_bytes: int = ANCHOR_BYTES, shard_bytes: int = SHARD_BYTES,
                   as_text: bool = False) -> DataFrame:
    """``doc_id, *carry, n_bytes, kept, spans`` of every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes; each byte goes that is covered by a string of ``length`` bytes which also
    starts in a text with a smaller doc_id. ``kept`` are the remaining bytes, ``spans`` the maximal
    removed runs as start, end, start, end, ...; ``as_text`` decodes what is kept, without characters
    that lost some of their bytes. A null text is empty; texts under ``length`` bytes
    lose nothing. Rows with one doc_id never remove each other's bytes, and a row with a null doc_id
    neither loses nor removes any. Other columns are ignored unless carried. Common prefixes are told
    to ``DEPTH`` letters, so a greater ``length`` raises an error.
    """
    if length > DEPTH:
        raise ValueError(f"repeats of {length} bytes: common prefixes are told to {DEPTH} letters only")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", *carry, body.alias("body"))
    rows = rows.withColumn("digest", F.substring(F.unhex(F.sha2("body", 256)), 1, DIGEST))
    total = rows.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts, anchor_shards, shards = (max(1, -(-total // size)) for size in (part_bytes, anchor_bytes, shard_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int"))

    found = rows.select("part", "doc_id", "digest", "body").mapInArrow(
        lambda batches: _anchored(batches, anchor_shards, length, gram), ANCHORS
    )
    requests = stored(found.groupBy("shard").applyInArrow(_repeated, REQUESTS), "repeated-anchors")

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _settled(key, batches, length)

    # Both groupings of the texts are one exchange of the plan.
    pieces = rows.groupBy("part").cogroup(requests.groupBy("part")).applyInArrow(
        lambda texts, wanted: _fragments(texts, wanted, shards, length), PIECES
    )
    spans = pieces.groupBy("shard").applyInArrow(settle, SPANS).union(_copies(rows, length))
    schema = rows.select("doc_id", *carry).schema.add("n_bytes", "long").add("kept", "string" if as_text else "binary").add("spans", T.ArrayType(T.LongType()))
    carried = ["doc_id", *carry]
    return rows.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(
        lambda texts, own: _trimmed(texts, own, carried, as_text), schema
    )


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """Texts that a smaller document has as well, which lose all."""
    long = rows.where((F.octet_length("body") >= length) & F.col("doc_id").isNotNull()).select("part", "doc_id", "digest")
    first = long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    nothing = [F.lit(None).cast("binary").alias(n) for n in ("numbers", "starts", "sizes")]
    return long.join(stored(first, "first-copies"), "digest").where("doc_id > first").select(
        "part", *nothing, F.col("doc_id").alias("copy_id"), F.col("digest").alias("copy_digest")
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``."""
    return remove_repeats(docs, **options).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def trim_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their repeated bytes removed from ``text`` and ``n_chars`` counted anew.

    A character that lost some of its bytes goes whole, and so does a document that lost all its text.
    Texts without repeats stay as they are, also null and empty ones.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("no text"), F.struct(*others).alias("row")).alias("rest")
    found = remove_repeats(docs.select("doc_id", "text", rest), carry=("rest",), as_text=True, **options)
    cut = F.size("spans") > 0
    left = found.where((F.length("kept") > 0) | ~cut)
    changed = {
        "text": F.when(~F.col("rest.no text"), F.col("kept")),
        "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("rest.row.n_chars")),
    }
    return left.select(*(changed[c].alias(c) if c in changed else F.col(f"rest.row.`{c}`").alias(c) for c in docs.columns))
