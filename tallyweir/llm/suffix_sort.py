"""Suffixes in order with their common prefixes, by induced sorting through bucket queues.

A suffix whose successor is placed is queued under its first letter; letters are served in order, and
what a letter's queue holds comes out in the order it went in, which is that of the successors. So the
queues together are a priority queue, and serving a letter is array arithmetic over all its suffixes.
With a suffix travels the common prefix it has with the one queued before it: one letter more than the
least common prefix between their successors. Suffixes at local minima, from which the rest is induced,
are sorted by inducing their substrings first and then ranking the string of the substrings' names.

Queues keep at most ``memory`` suffixes in memory and the rest in an unnamed scratch file, as a sort
keeps its runs.
"""

from __future__ import annotations

import tempfile
from typing import NamedTuple

import numpy as np

MEMORY_ITEMS = 32 << 20
#: Letters up to which order and common prefixes are exact.
DEPTH = 64


class _Queues:
    """First in, first out, for each letter; the oldest go to the scratch file."""

    def __init__(self, letters: int, memory: int):
        self.held: list[list] = [[] for _ in range(letters)]
        self.memory, self.items, self.file = memory, 0, None

    def put(self, letter: int, at: np.ndarray, common: np.ndarray) -> None:
        self.items += len(at)
        if self.items > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            place = self.file.seek(0, 2)
            at.tofile(self.file)
            common.tofile(self.file)
            self.held[letter].append((place, len(at), at.dtype, common.dtype))
            self.items -= len(at)
        else:
            self.held[letter].append((at, common))

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.held[letter] = self.held[letter], []
        read = []
        for part in parts:
            if len(part) == 4:
                place, count, kind, other = part
                self.file.seek(place)
                read.append((np.fromfile(self.file, kind, count), np.fromfile(self.file, other, count)))
            else:
                self.items -= len(part[0])
                read.append(part)
        if not read:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([a for a, _ in read]), np.concatenate([c for _, c in read])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Sorted(NamedTuple):
    suffixes: np.ndarray
    common: np.ndarray  # with the suffix before


class _Text:
    """Letters (the last is the only 0), which suffixes are less than the next, and runs of one letter."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters
        n = len(letters)
        last = np.flatnonzero(np.append(letters[1:] != letters[:-1], True))
        ends = np.repeat(last, np.diff(np.concatenate(([-1], last))))
        rises = np.append(letters[1:].astype(np.int32) > letters[:-1], True)
        self.less = rises[ends]
        self.run = np.minimum(ends - np.arange(n) + 1, DEPTH).astype(np.uint8)
        self.minima = np.flatnonzero(self.less[1:] & ~self.less[:-1]).astype(np.int32) + 1


def _push(queues: _Queues, letters: np.ndarray, before: np.ndarray, index: np.ndarray, common: np.ndarray,
          pending: dict[int, int], served: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Queue the suffixes ``before``, made by the sources number ``index`` of a batch; returns those of the letter being served.

    ``common`` are the common prefixes of the batch's sources, each with the source before; ``pending``
    holds for each letter the least of them since its last suffix.
    """
    own = None
    size = len(common)
    if len(before):
        first = letters[before]
        order = np.argsort(first, kind="stable")
        first, before, index = first[order], before[order], index[order]
        starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        # Least common prefix from the source after the last one of the same letter up to this one.
        bounds = np.empty(2 * len(index), np.int64)
        bounds[0::2] = np.append(0, index[:-1] + 1)
        bounds[0::2][starts] = 0
        bounds[1::2] = index + 1
        padded = np.append(common, np.uint8(255))
        least = np.minimum.reduceat(padded, np.minimum(bounds, size))[0::2]
        targets = first[starts].tolist()
        least[starts] = np.minimum(least[starts], [pending.get(t, 0) for t in targets])
        made = np.minimum(least.astype(np.int32) + 1, DEPTH).astype(np.uint8)
        stops = np.append(starts[1:], len(first))
        lasts = index[stops - 1]
        tail = np.minimum.reduceat(padded, np.minimum(np.ravel(np.column_stack((lasts + 1, np.full(len(lasts), size)))), size))[0::2]
        tails = dict(zip(targets, np.where(lasts + 1 < size, tail, 255).tolist(), strict=True))
        for t, a, b in zip(targets, starts.tolist(), stops.tolist(), strict=True):
            if t == served:
                own = (before[a:b], made[a:b])
            else:
                queues.put(t, before[a:b], made[a:b])
    else:
        tails = {}
    if size:
        lowest = int(common.min())
        for t in pending:
            if t not in tails:
                pending[t] = min(pending[t], lowest)
        pending.update(tails)
    return own


def _induce(text: _Text, minima: np.ndarray, between: np.ndarray, size: int, memory: int) -> Sorted:
    """All suffixes in order, from those at local minima in order; ``between`` are the latter's common prefixes."""
    letters, less, run = text.letters, text.less, text.run
    seeds = letters[minima]
    bounds = np.searchsorted(seeds, np.arange(size + 1))
    queues = _Queues(size, memory)
    falling: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(size):
        parts = [queues.take(c)]
        pending: dict[int, int] = {}
        while len(parts[-1][0]):
            at, common = parts[-1]
            index = np.flatnonzero((at > 0) & ~less[at - 1])
            own = _push(queues, letters, at[index] - 1, index, common, pending, c)
            if own is None:
                break
            parts.append(own)
        at = np.concatenate([p[0] for p in parts])
        common = np.concatenate([p[1] for p in parts])
        if len(common):
            common[0] = 0
        falling.append((at, common))
        lms = minima[bounds[c] : bounds[c + 1]]
        if len(lms):
            own = between[bounds[c] : bounds[c + 1]].copy()
            own[0] = min(run[at[-1]], run[lms[0]]) if len(at) else 0
            index = np.flatnonzero((lms > 0) & ~less[lms - 1])
            _push(queues, letters, lms[index] - 1, index, own, pending, -1)
    queues.close()

    queues = _Queues(size, memory)
    ordered: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(size - 1, -1, -1):
        parts = [queues.take(c)]
        pending = {}
        while len(parts[-1][0]):
            at, common = parts[-1]
            index = np.flatnonzero((at > 0) & less[at - 1])
            own = _push(queues, letters, at[index] - 1, index, common, pending, c)
            if own is None:
                break
            parts.append(own)
        at = np.concatenate([p[0] for p in parts])
        common = np.concatenate([p[1] for p in parts])
        if c == 0:
            # The end of the text, which nothing induces.
            at, common = np.array([len(letters) - 1], at.dtype), np.zeros(1, np.uint8)
        down, shared = falling[c][0][::-1], np.append(np.uint8(0), falling[c][1][:0:-1]) if len(falling[c][0]) else falling[c][1]
        edge = min(run[at[-1]], run[down[0]]) if len(at) and len(down) else 0
        if len(down):
            shared = shared.copy()
            shared[0] = edge
            index = np.flatnonzero((down > 0) & less[down - 1])
            _push(queues, letters, down[index] - 1, index, shared, pending, -1)
        elif c == 0:
            index = np.flatnonzero((at > 0) & less[at - 1])
            _push(queues, letters, at[index] - 1, index, common, pending, -1)
        if len(at):
            rising = np.append(np.uint8(edge), common[:0:-1])
            ordered.append((at[::-1], rising))
        if len(down):
            ordered.append(falling[c])
    queues.close()
    ordered.reverse()
    return Sorted(np.concatenate([a for a, _ in ordered]), np.concatenate([b for _, b in ordered]))


def _sorted_minima(text: _Text, size: int, memory: int) -> np.ndarray:
    """Suffixes at local minima in the order of their first ``DEPTH`` letters."""
    letters, minima = text.letters, text.minima
    if len(minima) <= 1:
        return minima
    rough = minima[np.argsort(letters[minima], kind="stable")]
    induced = _induce(text, rough, np.zeros(len(rough), np.uint8), size, memory).suffixes
    marked = np.zeros(len(letters), bool)
    marked[minima] = True
    order = induced[marked[induced]]
    # Names: substrings from one minimum to the next, equal if all letters are.
    number = np.zeros(len(letters), np.int32)
    number[minima] = np.arange(len(minima), dtype=np.int32)
    following = np.append(minima[1:], len(letters) - 1)
    sizes = following - minima + 1
    hashes = _substring_hashes(letters, minima, sizes)
    place = number[order]
    new = np.append(True, (hashes[place[1:]] != hashes[place[:-1]]) | (sizes[place[1:]] != sizes[place[:-1]]))
    rank = np.empty(len(minima), np.int64)
    # A name is the place of its first substring in the order.
    rank[place] = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    # A substring has two letters of its own at least, so DEPTH letters span half as many names.
    step = 1
    while 2 * step <= DEPTH:
        counts = np.bincount(rank, minlength=len(rank))
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied):
            break
        later = tied + step
        key = (rank[tied] << 32) | np.where(later < len(rank), rank[np.minimum(later, len(rank) - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, tied = key[by], tied[by]
        group = key >> 32
        start = np.searchsorted(group, group, side="left")
        changed = np.append(True, key[1:] != key[:-1])
        rank[tied] = group + np.maximum.accumulate(np.where(changed, np.arange(len(key)), 0)) - start
        step *= 2
    return minima[np.argsort(rank, kind="stable")]


def _substring_hashes(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    from tallyweir.llm.shingles import mixed, powers

    up, down = powers(len(letters) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)])))
    return mixed((total[starts + sizes] - total[starts]) * down[starts])


def _common_prefixes(letters: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix with the one before, letter by letter up to ``DEPTH``."""
    common = np.zeros(len(order), np.uint8)
    going = np.arange(1, len(order))
    for depth in range(DEPTH):
        a, b = order[going] + depth, order[going - 1] + depth
        inside = (a < len(letters)) & (b < len(letters))
        going, a, b = going[inside], a[inside], b[inside]
        going = going[letters[a] == letters[b]]
        if not len(going):
            break
        common[going] = depth + 1
    return common


def sort_suffixes(letters: np.ndarray, memory: int = MEMORY_ITEMS) -> Sorted:
    """The suffixes of ``letters`` (0 at the end only), exact in order and common prefixes up to ``DEPTH`` letters."""
    if not len(letters):
        return Sorted(np.zeros(0, np.int32), np.zeros(0, np.uint8))
    text = _Text(letters)
    size = int(letters.max()) + 1
    minima = _sorted_minima(text, size, memory)
    return _induce(text, minima, _common_prefixes(letters, minima), size, memory)
