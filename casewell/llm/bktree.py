"""BK-trees of 64-bit numbers as NumPy arrays, all trees of a run at once.

A node's children hang at the integer Hamming distance to it, one child at each distance. A
search within a radius follows from a node at distance d only the edges d - radius to d + radius:
by the triangle inequality nothing nearer hangs elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_WIDE = np.int64(65)  # distances 0 to 64
FRONTIER = 1 << 20  # pairs of a query and a node looked at together


def bounds(*keys: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal keys, and the number of rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


@dataclass
class Trees:
    """``values`` of all nodes; ``edges`` sorted, each ``node * 65 + distance``, and the child at each."""

    values: np.ndarray
    edges: np.ndarray
    children: np.ndarray

    def child(self, node: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The child at that distance, -1 if there is none."""
        if not len(self.edges):
            return np.full(len(node), -1)
        edge = node * _WIDE + distance
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where((self.edges[at] == edge) & (distance >= 0) & (distance <= 64), self.children[at], -1)

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a node (their places) of the tree under the query's root within the radius."""
        found_q, found_n = [], []
        waiting = [(np.arange(len(queries)), np.asarray(roots, np.int64))]
        while waiting:
            q, node = waiting.pop()
            if len(q) > FRONTIER:  # halves, depth first, so that memory stays bounded
                half = len(q) // 2
                waiting += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found_q.append(q[near])
            found_n.append(node[near])
            ways = [self.child(node, d + e) for e in range(-radius, radius + 1)]
            next_q = np.concatenate([q[w >= 0] for w in ways])
            if len(next_q):
                waiting.append((next_q, np.concatenate([w[w >= 0] for w in ways])))
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_n))


def grow(values: np.ndarray, cuts: np.ndarray) -> tuple[Trees, np.ndarray, np.ndarray]:
    """A tree of each run of distinct ``values`` between ``cuts``, its first value the root. Also every
    node's parent (a root's own place) and the distance to it. One pass for each level, over all trees."""
    sizes = np.diff(cuts)
    at = np.repeat(cuts[:-1], sizes)
    parent, distance = at.copy(), np.zeros(len(values), np.int64)
    left = np.flatnonzero(at != np.arange(len(values)))
    edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        d = np.bitwise_count(values[left] ^ values[at[left]]).astype(np.int64)
        edge, first, group = np.unique(at[left] * _WIDE + d, return_index=True, return_inverse=True)
        child = left[first]
        parent[child], distance[child] = at[child], d[first]
        edges.append(edge)
        children.append(child)
        at[left] = child[group]
        left = left[at[left] != left]
    edge, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edge)
    return Trees(values, edge[order], child[order]), parent, distance


def hung(values: np.ndarray, parent: np.ndarray, distance: np.ndarray) -> Trees:
    """Trees put together again from every node's parent and the distance to it."""
    own = np.arange(len(values))
    edge, child = (parent * _WIDE + distance)[parent != own], own[parent != own]
    order = np.argsort(edge)
    return Trees(values, edge[order], child[order])


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``a, b`` as at most one link for each value: to the least value it reaches by them."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(ids))
    while len(x):
        p, q = low[x], low[y]
        if (p == q).all():
            break
        least = np.minimum(p, q)
        np.minimum.at(low, p, least)
        np.minimum.at(low, q, least)
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(ids))
    return ids[moved], ids[low[moved]]
