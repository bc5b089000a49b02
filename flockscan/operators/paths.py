"""Shortest paths of a graph that one task holds: sources go through it side by side.

Trees that hang on the rest are folded into the node they hang on, as every path out of them is
known. The other nodes are numbered by falling degree. A matrix has a row per node and a column
per source, and a step along the edges adds up rows of neighbours, for all sources at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# Executors receive the functions below with the plan; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of a matrix of nodes and sources, and sources side by side, at most.
CELLS, SIDE_BY_SIDE = 1 << 23, 48
# Cells that are added up at once, so that they stay in the processor's cache.
CACHED_CELLS = 1 << 16
# The neighbours of nodes with more of them are added up a node at a time.
HUB_DEGREE = 64
# Edges take so many times longer where they have to be sorted by their ends first.
SORTED_WAYS = 4


@dataclass
class Graph:
    """Neighbours of node i are ``ends[at[i]:at[i + 1]]``; ``number`` is what its node was called.

    ``weight`` nodes are folded into node i, itself among them, and ``asking`` sources into the
    nodes ``sources``. ``aside`` holds by number what of the paths from or to a folded node runs
    through a node of its tree.
    """

    ends: np.ndarray
    at: np.ndarray
    degree: np.ndarray
    number: np.ndarray
    weight: np.ndarray
    sources: np.ndarray
    asking: np.ndarray
    aside: np.ndarray

    @property
    def width(self) -> int:
        """Sources that go side by side."""
        return max(1, min(SIDE_BY_SIDE, CELLS // max(1, len(self.number))))


def _folded(source: np.ndarray, target: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(weight, asking, crossing, steps)``: leaves go into their neighbours until none is left.

    Nodes and sources of each tree, and the sum over its branches of their product; each step
    has the nodes that went and those that took them.
    """
    degree = np.bincount(source, minlength=len(asked)) + np.bincount(target, minlength=len(asked))
    # Of a leaf it is its neighbour: all neighbours, those that went taken out again.
    link = np.zeros(len(asked), np.int64)
    np.bitwise_xor.at(link, source, target)
    np.bitwise_xor.at(link, target, source)
    weight, asking, crossing = np.ones(len(asked), np.int64), asked.copy(), np.zeros(len(asked), np.int64)
    steps = []
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        up = link[leaves]
        # Of two that are each other's neighbour one stays.
        goes = (degree[up] > 1) | (leaves > up)
        leaves, up = leaves[goes], up[goes]
        degree[leaves] = 0
        np.subtract.at(degree, up, 1)
        np.bitwise_xor.at(link, up, leaves)
        np.add.at(weight, up, weight[leaves])
        np.add.at(asking, up, asking[leaves])
        np.add.at(crossing, up, weight[leaves] * asking[leaves])
        steps.append((leaves, up))
        leaves = np.unique(up[degree[up] == 1])
    return weight, asking, crossing, steps


def _least(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least node that each node is joined with."""
    label, before = np.arange(len(at) - 1), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(before, np.minimum.reduceat(before[ends], at[:-1]))
        np.minimum.at(label, before, label.copy())
        label = label[label]
    return label


def packed(source: np.ndarray, target: np.ndarray, nodes: int, asked: np.ndarray | None) -> Graph:
    """The graph of the edges between ``nodes`` nodes 0, 1, ..., each with an edge; ``asked`` are its sources."""
    own = np.ones(nodes, np.int64) if asked is None else np.bincount(asked, minlength=nodes)
    weight, asking, crossing, steps = _folded(source, target, own)
    stays = np.ones(nodes, bool)
    for gone, _ in steps:
        stays[gone] = False
    both = stays[source] & stays[target]
    source, target = source[both], target[both]
    degree = np.bincount(source, minlength=nodes) + np.bincount(target, minlength=nodes)
    number = np.argsort(-degree, kind="stable")[: np.count_nonzero(degree)]
    place = np.zeros(nodes, np.int64)
    place[number] = np.arange(len(number))
    ways = np.empty(2 * len(source), np.int64)
    ways[: len(source)] = place[source] << 32 | place[target]
    ways[len(source) :] = place[target] << 32 | place[source]
    ways.sort()
    degree = degree[number]
    at = np.concatenate([[0], np.cumsum(degree)])
    ends = (ways & 0xFFFFFFFF).astype(np.int32)
    # Nodes and sources of a component: those of its least node, first counted for nodes that stay.
    root = np.arange(nodes)
    if len(number):
        root[number] = number[_least(ends, at)]
    for gone, up in reversed(steps):
        root[gone] = root[up]
    every, all_asking = (np.bincount(root, minlength=nodes, weights=x)[root] for x in (np.ones(nodes), own))
    # From a branch to all outside of it, and from outside of the tree into its branches.
    aside = (every - 1) * (asking - own) - crossing + (all_asking - asking) * (weight - 1)
    # Sources that share their largest neighbour, that one's own and so on go side by side: they
    # reach the same nodes about together.
    sources = np.flatnonzero(asking[number])
    if len(sources):
        up = np.minimum(np.minimum.reduceat(ends, at[:-1]), np.arange(len(number)))
        kin = [up]
        for _ in range(3):
            kin.append(up[kin[-1]])
        sources = sources[np.lexsort([of[sources] for of in kin])]
    return Graph(ends, at, degree, number, weight[number], sources, asking[number][sources], aside)


Sums = Iterator[tuple[np.ndarray, np.ndarray]]


def _sums(values: np.ndarray, froms: np.ndarray, start: np.ndarray, count: np.ndarray, to: np.ndarray) -> Sums:
    """For some nodes ``to`` at a time, each one's sum of ``values`` of the rows ``froms[start:start + count]``.

    Counts fall, and none is 0.
    """
    step = max(1, CACHED_CELLS // values.shape[1])
    hubs = int(np.searchsorted(-count, -HUB_DEGREE))
    for x in range(0, hubs, step):
        some = slice(x, min(x + step, hubs))
        got = np.empty((some.stop - x, values.shape[1]))
        for i, (s, c) in enumerate(zip(start[some].tolist(), count[some].tolist(), strict=True)):
            np.add.reduce(values.take(froms[s : s + c], axis=0), axis=0, out=got[i])
        yield to[some], got
    taken = np.empty((step, values.shape[1]))
    for x in range(hubs, len(to), step):
        first, left = start[x : x + step], count[x : x + step]
        got = values.take(froms[first], axis=0)
        # Those with another row come first.
        more = np.searchsorted(-left, -np.arange(1, left[0]))
        for j, m in enumerate(more.tolist(), 1):
            got[:m] += np.take(values, froms[first[:m] + j], axis=0, out=taken[:m], mode="clip")
        yield to[x : x + step], got


def _stepped(graph: Graph, values: np.ndarray, rows: np.ndarray, to: np.ndarray, ways: int) -> tuple[bool, Sums]:
    """Sums of the neighbours' values, which only ``rows`` have, for all nodes ``to`` or for all with such a neighbour.

    Edges are gone through from ``to``, which has ``ways`` of them, or from ``rows`` if those have
    far fewer; also told is whether it was from ``to``.
    """
    degree = graph.degree[rows]
    if SORTED_WAYS * int(degree.sum()) >= ways:
        return True, _sums(values, graph.ends, graph.at[to], graph.degree[to], to)
    before = np.cumsum(degree) - degree
    ends = graph.ends[np.repeat(graph.at[rows] - before, degree) + np.arange(degree.sum())]
    order = np.argsort(ends, kind="stable")
    ends, froms = ends[order], np.repeat(rows, degree)[order]
    first = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
    count = np.diff(np.append(first, len(ends)))
    order = np.argsort(-count, kind="stable")
    first = first[order]
    return False, _sums(values, froms, first, count[order], ends[first])


def _one_batch(graph: Graph, batch: slice, scratch: list[np.ndarray]) -> np.ndarray:
    """What of the shortest paths from the sources of a batch runs through each node, ends left out."""
    sources = graph.sources[batch]
    # Rows stay side by side in memory: values of a cut matrix would be copied whole whenever some are taken.
    cells = len(graph.number) * len(sources)
    paths, here, there, level = (flat[:cells].reshape(-1, len(sources)) for flat in scratch)
    for matrix in (paths, here, there):
        matrix.fill(0)
    level.fill(-1)
    each = np.arange(len(sources))
    paths[sources, each] = here[sources, each] = 1
    level[sources, each] = 0
    rows = np.sort(sources)
    met, unmet = [rows], np.arange(len(graph.number))
    unmet_ways = int(graph.degree.sum())
    while len(rows):
        found, left = [rows[:0]], [rows[:0]]
        whole, sums = _stepped(graph, here, rows, unmet, unmet_ways)
        for some, got in sums:
            known = paths[some]
            fresh = (got != 0) & (known == 0)
            got *= fresh
            known += got
            paths[some] = known
            if whole:
                left.append(some[(known == 0).any(axis=1)])
            any_fresh = fresh.any(axis=1)
            if not any_fresh.all():
                some, fresh, got = some[any_fresh], fresh[any_fresh], got[any_fresh]
            there[some] = got
            level[some] = np.where(fresh, len(met), level[some])
            found.append(some)
        here[rows] = 0
        here, there = there, here
        rows = np.sort(np.concatenate(found))
        met.append(rows)
        if whole:
            unmet = np.concatenate(left)
            unmet_ways = int(graph.degree[unmet].sum())
    # Shares go back from the farthest level; both matrices of a level are empty again.
    shares, part = here, there
    step = max(1, CACHED_CELLS // len(sources))
    for depth in range(len(met) - 2, 0, -1):
        rows = met[depth]
        for x in range(0, len(rows), step):
            some = rows[x : x + step]
            on = level[some] == depth
            shares[some] = np.divide(graph.weight[some, None] + part[some], paths[some], out=np.zeros(on.shape), where=on)
        if depth > 1:
            to = met[depth - 1]
            for some, got in _stepped(graph, shares, rows, to, int(graph.degree[to].sum()))[1]:
                got *= level[some] == depth - 1
                part[some] += got * paths[some]
        shares[rows] = 0
    return part @ graph.asking[batch].astype(float)


def through(graph: Graph, task: int, tasks: int) -> np.ndarray:
    """By number, what of the shortest paths from a task's sources runs through each node."""
    width, nodes = graph.width, len(graph.number)
    scratch = [np.empty(nodes * width, kind) for kind in (float, float, float, np.int32)]
    total = np.zeros(nodes)
    for x in range(task * width, len(graph.sources), tasks * width):
        total += _one_batch(graph, slice(x, x + width), scratch)
    # The paths of the trees are nobody's, so the first task gives them.
    found = graph.aside.astype(float) if task == 0 else np.zeros(len(graph.aside))
    found[graph.number] += total
    return found
