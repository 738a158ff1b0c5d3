"""Cover trees over the rows of one block: whole subtrees go to a codebook entry at once.

A node stands for consecutive rows of the tree's order: one of them is its centre, and none is
farther from it than the radius. The entries that can be nearest to a row of a node are those not more
than two radii farther from the centre than the nearest one; where one is left, the node goes to it
whole, and its count and sums are differences of running sums. Only ambiguous nodes are opened.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Each level's nodes have at most a radius smaller by this factor.
SHRINK = 1.5
# Nodes of so many rows are not divided.
LEAF_ROWS = 24
# Whole numbers that doubles hold exactly.
EXACT_DOUBLE = 1 << 53
# Distances are roots of exact squares; a bound must fail by more than their rounding.
SLACK = 1e-9


class Tree(NamedTuple):
    """Rows in tree order, and the nodes: the root first, the children of a node side by side."""

    order: np.ndarray  # int32, row numbers
    start: np.ndarray  # int32, places in the order
    end: np.ndarray
    centre: np.ndarray  # int32, a row number
    radius: np.ndarray  # float64
    child: np.ndarray  # int32, number of the first child
    children: np.ndarray  # int32, 0 for a leaf

    def packed(self) -> list[bytes]:
        return [column.tobytes() for column in self]

    @classmethod
    def unpacked(cls, columns: list[bytes]) -> Tree:
        kinds = (np.int32, np.int32, np.int32, np.int32, np.float64, np.int32, np.int32)
        return cls(*(np.frombuffer(c, k) for c, k in zip(columns, kinds, strict=True)))


def squares(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows, one line for each of ``rows``."""
    reach = int(np.abs(rows).max(initial=0)) + int(np.abs(others).max(initial=0))
    if reach * reach * max(rows.shape[1], 1) < EXACT_DOUBLE:
        a, b = rows.astype(np.float64), others.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return np.stack([((rows - other) ** 2).sum(axis=1) for other in others], axis=1)


def build(points: np.ndarray) -> Tree:
    """The tree of the rows of an integer matrix; equal rows end in one node of radius 0.

    A node's children cover it greedily: the first row left becomes a centre and takes all rows left
    within the smaller radius. Memory is a few numbers a row, whatever the depth.
    """
    order = np.arange(len(points), dtype=np.int32)
    start, end, centre, radius, child, children = [0], [len(points)], [0], [0.0], [0], [0]
    if not len(points):
        return _tree(order, start, end, centre, radius, child, children)
    distance = np.sqrt(squares(points, points[:1])[:, 0])
    radius[0] = float(distance.max())
    open_ = [(0, distance)]
    while open_:
        node, distance = open_.pop()
        if radius[node] == 0 or end[node] - start[node] <= LEAF_ROWS:
            continue
        smaller = radius[node] / SHRINK
        left = order[start[node] : end[node]]
        at, own, first = start[node], centre[node], len(start)
        new_order = []
        while len(left):
            near = distance <= smaller
            taken, d = left[near], distance[near]
            start.append(at)
            at += len(taken)
            end.append(at)
            centre.append(own)
            radius.append(float(d.max()))
            child.append(0)
            children.append(0)
            open_.append((len(start) - 1, d))
            new_order.append(taken)
            left = left[~near]
            if len(left):
                own = int(left[0])
                distance = np.sqrt(squares(points[left], points[own : own + 1])[:, 0])
        order[start[node] : end[node]] = np.concatenate(new_order)
        child[node], children[node] = first, len(start) - first
    return _tree(order, start, end, centre, radius, child, children)


def _tree(order, start, end, centre, radius, child, children) -> Tree:
    ints = (np.array(c, np.int32) for c in (start, end, centre))
    return Tree(order, *ints, np.array(radius), np.array(child, np.int32), np.array(children, np.int32))


class Assigned(NamedTuple):
    """What went where: runs of the tree's order that went whole, and single rows compared exactly."""

    start: np.ndarray
    end: np.ndarray
    entry: np.ndarray
    row: np.ndarray
    row_entry: np.ndarray


def assign(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> Assigned:
    """Each row's nearest entry of the codebook, ties to the lower number."""
    whole: list[tuple] = []
    single: list[tuple] = []
    if not len(points):
        none = np.zeros(0, np.int64)
        return Assigned(none, none, none, none, none)
    every = np.arange(len(codebook))
    # Nodes side by side, and the entries that can be nearest to one of their rows.
    open_ = [(np.zeros(1, np.int64), every)]
    while open_:
        nodes, entries = open_.pop()
        found = squares(points[tree.centre[nodes]], codebook[entries])
        best = found.argmin(axis=1)
        distance = np.sqrt(found)
        least = distance[np.arange(len(nodes)), best]
        reach = least + 2 * tree.radius[nodes]
        can = distance <= (reach * (1 + SLACK) + SLACK)[:, None]
        # A node of equal rows is as good as one row: the tie is settled at its centre.
        done = (tree.radius[nodes] == 0) | (can.sum(axis=1) == 1)
        whole.append((tree.start[nodes[done]], tree.end[nodes[done]], entries[best[done]]))
        for i in np.flatnonzero(~done).tolist():
            node, among = nodes[i], entries[can[i]]
            if tree.children[node]:
                open_.append((np.arange(tree.child[node], tree.child[node] + tree.children[node]), among))
            else:
                rows = tree.order[tree.start[node] : tree.end[node]]
                single.append((rows, among[squares(points[rows], codebook[among]).argmin(axis=1)]))
    starts, ends, to = (np.concatenate(c).astype(np.int64) for c in zip(*whole, strict=True))
    rows, row_to = (np.concatenate(c).astype(np.int64) for c in zip(*single, strict=True)) if single else (np.zeros(0, np.int64),) * 2
    return Assigned(starts, ends, to, rows, row_to)


def totals(points: np.ndarray, tree: Tree, found: Assigned, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the rows of each entry: of whole runs by the running sums."""
    counts = np.zeros(entries, np.int64)
    sums = np.zeros((entries, points.shape[1]), np.int64)
    running = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points[tree.order], axis=0, out=running[1:])
    np.add.at(counts, found.entry, found.end - found.start)
    np.add.at(sums, found.entry, running[found.end] - running[found.start])
    np.add.at(counts, found.row_entry, 1)
    np.add.at(sums, found.row_entry, points[found.row])
    return counts, sums


def labels(tree: Tree, found: Assigned) -> np.ndarray:
    """The entry of every row, by row number."""
    out = np.zeros(len(tree.order), np.int64)
    sizes = found.end - found.start
    places = np.repeat(found.start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    out[tree.order[places]] = np.repeat(found.entry, sizes)
    out[found.row] = found.row_entry
    return out
