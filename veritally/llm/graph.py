"""A directed graph over vectors that greedy search can follow: built by robust pruning, searched by a beam.

Points are inserted in batches. A greedy search from the entry point proposes neighbours; robust
pruning takes the nearest, drops what is nearer to it than to the point by the factor `relax`, and goes
on, so that the edges kept lead in different directions. Edges back are added, and lists that grow too
long are pruned in the same way. All steps work on a batch of points at once.

Nearness is the inner product. Lengths are made equal by one more coordinate, which changes no
inner product with a query (its coordinate is zero) and makes the largest product the least distance.
"""

from __future__ import annotations

import numpy as np

#: Points inserted, or queries searched, at a time.
BATCH = 256
#: Nodes of a beam that a step expands.
WIDTH = 4


def levelled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a coordinate more that gives all the length of the longest, 1 in all."""
    vectors = vectors / np.abs(vectors).max()
    squares = np.einsum("nd,nd->n", vectors, vectors)
    longest = squares.max()
    last = np.sqrt(np.maximum(longest - squares, 0))
    return (np.column_stack([vectors, last]) / np.sqrt(longest)).astype(np.float32)


def _products(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of each query with its own points: (b, k) ids and (b, d) queries."""
    return np.matmul(points[ids], queries[:, :, None])[:, :, 0]


def search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Per query the nodes of its final beam, nearest first, -1 where there are fewer. Rows of queries are at most BATCH."""
    n = len(queries)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column is for missing edges
    seen[:, [entry, -1]] = True
    ids, near = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32)
    ids[:, 0], near[:, 0] = entry, queries @ points[entry]
    done = ids < 0
    rows = np.arange(n)
    while len(rows):
        # The nearest nodes not yet expanded; beams are sorted.
        first = np.argsort(done[rows], axis=1, kind="stable")[:, :WIDTH]
        at = rows[:, None]
        nodes = np.where(done[at, first], -1, ids[at, first])
        done[at, first] = True
        found = np.where((nodes >= 0)[:, :, None], edges[nodes], -1).reshape(len(rows), -1)
        found = np.sort(found, axis=1)
        new = ~seen[at, found]
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[at, found] = True
        # Few of them are new: those are moved to the front.
        most = int(new.sum(axis=1).max(initial=0))
        if most:
            front = np.argsort(~new, axis=1, kind="stable")[:, :most]
            found, new = np.take_along_axis(found, front, 1), np.take_along_axis(new, front, 1)
            products = np.where(new, _products(points, found, queries[rows]), -np.inf)
            all_near = np.concatenate([near[rows], products], axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[rows] = np.take_along_axis(all_near, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, found, -1)], axis=1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], axis=1), best, 1)
        rows = rows[~done[rows].all(axis=1)]
    return ids


def prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Per owner up to so many of its candidates (-1: none), the nearest first and each in a direction of its own."""
    own = points[owners]
    near = np.where(candidates < 0, -np.inf, _products(points, candidates, own))
    order = np.argsort(-near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    alive = candidates >= 0
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]  # one point twice is nearest twice, in a row
    alive &= candidates != owners[:, None]
    among = points[candidates]
    between = 1 - np.matmul(among, among.transpose(0, 2, 1))  # half of squared distances: all lengths are 1
    far = 1 - near
    kept = np.full((len(owners), degree), -1, np.int32)
    rows = np.arange(len(owners))
    for turn in range(degree):
        pick = alive.argmax(axis=1)
        there = alive[rows, pick]
        if not there.any():
            break
        kept[there, turn] = candidates[rows, pick][there]
        alive &= (relax * relax * between[rows, pick] > far) | ~there[:, None]
        alive[rows, pick] = False
    return kept


def build(points: np.ndarray, degree: int, beam: int, relax: float, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (n, width; -1: none) and the entry point. Points have equal lengths."""
    n = len(points)
    entry = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    width = degree + degree // 2
    edges, sizes = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
    start = 1
    while start < n:
        # Early batches are small, as there is little to search.
        batch = order[start : start + min(BATCH, max(1, start // 2))]
        start += len(batch)
        found = search(points, edges, entry, points[batch], beam)
        kept = prune(points, batch, found, degree, relax)
        edges[batch, :degree], sizes[batch] = kept, (kept >= 0).sum(axis=1)
        _add_back(points, edges, sizes, batch, kept, degree, relax)
    return _all_reached(points, edges, entry, beam), entry


def _all_reached(points: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """Edges, with more where pruning has cut a node off from the entry: from the nearest node that a search finds."""
    while True:
        reached, front = np.zeros(len(points), bool), np.array([entry])
        while len(front):
            reached[front] = True
            near = np.unique(edges[front])
            front = near[(near >= 0) & ~reached[near]]
        lost = np.flatnonzero(~reached)[:BATCH]
        if not len(lost):
            return edges
        source = search(points, edges, entry, points[lost], beam)[:, 0]
        order = np.argsort(source, kind="stable")
        _, first, counts = np.unique(source[order], return_index=True, return_counts=True)
        more = np.full((len(points), counts.max()), -1, np.int32)
        more[source[order], np.arange(len(lost)) - np.repeat(first, counts)] = lost[order]
        edges = np.concatenate([edges, more], axis=1)


def _add_back(points, edges, sizes, batch, kept, degree, relax) -> None:
    """Edges from the kept neighbours to the batch; lists beyond the width are pruned to the degree."""
    to, target = np.repeat(batch, degree)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    to, target = to[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    room = edges.shape[1] - sizes[nodes]
    slot = np.arange(len(target)) - np.repeat(first, counts) + np.repeat(sizes[nodes], counts)
    fits = np.repeat(counts <= room, counts)
    edges[target[fits], slot[fits]] = to[fits]
    sizes[nodes[counts <= room]] += counts[counts <= room]
    long = nodes[counts > room]
    for start in range(0, len(long), BATCH):
        some = long[start : start + BATCH]
        width = int(counts[np.searchsorted(nodes, some)].max()) + edges.shape[1]
        lists = np.full((len(some), width), -1, np.int32)
        lists[:, : edges.shape[1]] = edges[some]
        mine = np.isin(target, some)
        lists[np.searchsorted(some, target[mine]), slot[mine]] = to[mine]
        edges[some] = -1
        edges[some, :degree] = prune(points, some, lists, degree, relax)
        sizes[some] = (edges[some] >= 0).sum(axis=1)
