"""Distinct word shingles of texts as 64-bit hashes, by array arithmetic over all texts of a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyweir.llm.common import flat_bytes, lower_bytes, release_memory

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)


_known: list[tuple[np.ndarray, np.ndarray]] = []


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``count`` powers of the base and of its inverse modulo 2**64, kept by the worker."""
    if not _known or len(_known[0][0]) < count:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = -(-count // (1 << 20)) << 20
        _known[:] = [tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, x))) for x in (BASE, inverse))]
    return _known[0]


def forget_powers() -> None:
    """For the end of a task: workers idle between tasks, and their memory adds up."""
    _known.clear()
    release_memory()


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    return (values ^ (values >> np.uint64(29))) * MIX ^ (values >> np.uint64(32))


def _separators() -> np.ndarray:
    between = np.zeros(256, bool)
    between[9:14] = True
    between[32] = True
    return between


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every lower-cased word, and each text's first word with the total at the end."""
    flat, offsets = flat_bytes(texts)
    inside = ~_separators()[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(flat)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(flat) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((lower_bytes()[flat].astype(np.uint64) + np.uint64(1)) * up[: len(flat)])))
    hashed = mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * MIX)
    return hashed, np.searchsorted(starts, offsets, side="left")


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of ``size`` words in a row; of all words if there are fewer."""
    words, bounds = word_hashes(texts)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(size):
        rolled[: len(words) - k] = (rolled[: len(words) - k] * BASE) + words[k:]
    rolled = mixed(rolled + np.uint64(size))
    sets = []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if stop - start >= size:
            sets.append(np.unique(rolled[start : stop - size + 1]))
        elif stop > start:
            whole = 0
            for w in words[start:stop].tolist():
                whole = whole * int(BASE) + w
            sets.append(mixed(np.array([(whole + stop - start) % (1 << 64)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
