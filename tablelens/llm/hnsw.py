"""A navigable small-world graph over unit vectors, with numpy.

Nodes enter in batches. A batch is searched in the graph so far and compared
within itself, each node keeps diverse near neighbours (one that is closer to a
neighbour already kept than to the node is passed over), and neighbours link
back. Upper layers hold every ``1/fanout``-th node and lead a search to a good
start in the layer below. Searches run for many queries side by side: in each
step every query opens its best unopened candidate.
"""

from __future__ import annotations

import numpy as np

_FANOUT = 16
_TOP = 96  # a layer of at most so many nodes is scanned


def _diverse(sims: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """From candidates sorted by similarity (-1: none) ``keep`` per row, diverse ones first."""
    rows, width = nodes.shape
    found = vectors[np.maximum(nodes, 0)]
    between = np.matmul(found, found.transpose(0, 2, 1))
    chosen, count = np.zeros((rows, width), bool), np.zeros(rows, int)
    for c in range(width):
        nearer = (np.where(chosen, between[:, c, :], -2.0) > sims[:, c, None]).any(axis=1)
        take = (nodes[:, c] >= 0) & ~nearer & (count < keep)
        chosen[:, c] = take
        count += take
    order = np.argsort(np.where(nodes < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(nodes, order, axis=1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


class Layer:
    """Adjacency of one layer; nodes are rows of ``vectors``, -1 pads."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray) -> None:
        self.vectors, self.neighbours = vectors, neighbours

    def search(self, queries: np.ndarray, starts: np.ndarray, beam: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``beam`` best nodes met (sorted; -1 pads) and their similarities. starts: [query, k], -1 pads."""
        n, rows = size or len(self.vectors), len(queries)
        beam = max(beam, starts.shape[1])
        seen = np.zeros((rows, n), bool)
        every = np.arange(rows)
        nodes = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -2.0, np.float32)
        nodes[:, : starts.shape[1]] = starts
        ok = starts >= 0
        sims[:, : starts.shape[1]] = np.where(ok, np.einsum("qkd,qd->qk", self.vectors[np.maximum(starts, 0)], queries), -2.0)
        seen[np.repeat(every, ok.sum(1)), starts[ok]] = True
        order = np.argsort(-sims, axis=1, kind="stable")
        nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
        opened = nodes < 0
        while (live := np.flatnonzero(~opened.all(axis=1))).size:
            at = np.argmin(opened[live], axis=1)  # the best that is not opened
            opened[live, at] = True
            near = self.neighbours[nodes[live, at]]
            ok = near >= 0
            ok &= ~seen[live[:, None], np.maximum(near, 0)]
            seen[np.repeat(live, ok.sum(1)), near[ok]] = True
            value = np.where(ok, np.einsum("qkd,qd->qk", self.vectors[np.maximum(near, 0)], queries[live]), -2.0).astype(np.float32)
            better = (value > sims[live, -1:]).any(axis=1)
            live, near, value, ok = live[better], near[better], value[better], ok[better]
            if not len(live):
                continue
            all_nodes = np.concatenate([nodes[live], np.where(ok, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], value], axis=1)
            all_open = np.concatenate([opened[live], ~ok], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            nodes[live] = np.take_along_axis(all_nodes, order, 1)
            sims[live] = np.take_along_axis(all_sims, order, 1)
            opened[live] = np.take_along_axis(all_open, order, 1)
        return nodes, sims


class Hnsw:
    """Layers from the whole set up to a small top; ``members[l]`` maps a layer's rows to rows of the set."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], neighbours: list[np.ndarray]) -> None:
        self.vectors, self.members = vectors, members
        self.layers = [Layer(vectors if len(m) == len(vectors) else vectors[m], a) for m, a in zip(members, neighbours)]

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = 16, beam: int = 48, seed: int = 7) -> Hnsw:
        """``vectors``: unit rows as float32, in any order."""
        order = np.random.default_rng(seed).permutation(len(vectors))
        members = [np.sort(order)]
        while len(members[-1]) > _TOP:
            members.append(np.sort(order[: max(1, len(members[-1]) // _FANOUT)]))
        graph = cls(vectors, [], [])
        neighbours = []
        for level in range(len(members) - 1, -1, -1):
            own = members[level]
            above = cls(vectors, members[level + 1:], neighbours)
            neighbours.insert(0, _connect(vectors[own], own, above, links, beam, seed + level))
        graph = cls(vectors, members, neighbours)
        return graph

    def starts(self, queries: np.ndarray, level: int = 0, width: int = 4) -> np.ndarray:
        """Rows of the whole set near each query, found in the layers from ``level`` up."""
        found = None
        for k in range(len(self.layers) - 1, level - 1, -1):
            layer, own = self.layers[k], self.members[k]
            if found is None:
                sims = queries @ layer.vectors.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            else:
                best, _ = layer.search(queries, np.where(found >= 0, np.searchsorted(own, np.maximum(found, 0)), -1), 2 * width)
                best = best[:, :width]
            found = np.where(best >= 0, own[np.maximum(best, 0)], -1)
        return found

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query up to ``beam`` rows of the set (-1 pads), by falling similarity, and the similarities."""
        if len(self.layers) == 1:
            sims = queries @ self.vectors.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            return order, np.take_along_axis(sims, order, 1)
        return self.layers[0].search(queries, self.starts(queries, 1), beam)


def _connect(vectors: np.ndarray, own: np.ndarray, above: Hnsw, links: int, beam: int, seed: int) -> np.ndarray:
    """Adjacency of one layer. Rows enter in a random order, those of the layer above first."""
    n, width = len(vectors), 2 * links
    neighbours = np.full((n, width), -1, np.int64)
    if n <= 1:
        return neighbours
    order = np.random.default_rng(seed).permutation(n)
    if above.members:
        upper = np.searchsorted(own, above.members[0])
        order = np.concatenate([upper, order[~np.isin(order, upper)]])
    graph, done = Layer(vectors, neighbours), 0
    while done < n:
        batch = order[done:done + min(1024, max(256, done))]
        q = vectors[batch]
        within = q @ q.T
        np.fill_diagonal(within, -2.0)
        k = min(beam // 2, len(batch))
        near = np.argsort(-within, axis=1, kind="stable")[:, :k]
        nodes, sims = batch[near], np.take_along_axis(within, near, 1)
        nodes = np.where(sims > -2, nodes, -1)
        if done:
            if above.members:
                found = above.starts(q)
                start = np.where(found >= 0, np.searchsorted(own, np.maximum(found, 0)), -1)
                # A node of the layer above that has not entered yet is no start.
                start = np.where(np.isin(start, order[:done]), start, -1)
                start = np.where((start >= 0).any(axis=1)[:, None], start, order[0])
            else:
                start = np.full((len(batch), 1), order[0])
            met, value = graph.search(q, start, beam)
            nodes, sims = np.concatenate([nodes, met], axis=1), np.concatenate([sims, value], axis=1)
        by = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        nodes, sims = np.take_along_axis(nodes, by, 1), np.take_along_axis(sims, by, 1)
        neighbours[batch, :links] = _diverse(sims, nodes, vectors, links)
        _link_back(vectors, neighbours, batch, links, width)
        done += len(batch)
    return neighbours


def _link_back(vectors: np.ndarray, neighbours: np.ndarray, batch: np.ndarray, links: int, width: int) -> None:
    """Each neighbour of a new node gets the node as a neighbour; full lists keep diverse ones."""
    source = np.repeat(batch, links)
    target = neighbours[batch, :links].ravel()
    source, target = source[target >= 0], target[target >= 0]
    for _ in range(64):
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, count)
        now = nth < width  # more newcomers than a list holds come in the next turn
        fresh = np.full((len(nodes), width), -1, np.int64)
        fresh[np.repeat(np.arange(len(nodes)), count)[now], nth[now]] = source[now]
        old = neighbours[nodes]
        fresh = np.where((fresh[:, :, None] == old[:, None, :]).any(axis=2), -1, fresh)
        both = np.concatenate([old, fresh], axis=1)
        fits = (both >= 0).sum(axis=1) <= width
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        neighbours[nodes[fits]] = packed[fits, :width]
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), 512):
            part = full[at:at + 512]
            sims = np.einsum("qkd,qd->qk", vectors[np.maximum(both[part], 0)], vectors[nodes[part]])
            sims = np.where(both[part] >= 0, sims, -2.0)
            by = np.argsort(-sims, axis=1, kind="stable")
            neighbours[nodes[part]] = _diverse(np.take_along_axis(sims, by, 1), np.take_along_axis(both[part], by, 1), vectors, width)
        source, target = source[~now], target[~now]
