"""A navigable small-world graph in layers over one shard of unit vectors, searched by many queries at once."""

from __future__ import annotations

import numpy as np

#: Neighbours kept per node in upper layers (twice as many in the lowest), nearest and drawn candidates, nodes linked at once.
DEGREE, CANDIDATES, FAR, BATCH = 12, 48, 4, 256
#: Nodes that a query's beam expands in one step.
STEP = 4


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `width` nodes that each query reaches from its entry nodes, best first, with their cosines.

    Places that stay empty hold -1 and a cosine below any. A query ends when no node of its beam is unexpanded."""
    n, count = len(vectors), len(queries)
    seen = np.zeros((count, n), bool)
    ids = np.full((count, width), -1, np.int64)
    near = np.full((count, width), -9.0)
    done = np.ones((count, width), bool)
    entry = entry[:, :width]
    ids[:, :entry.shape[1]] = entry
    near[:, :entry.shape[1]] = np.where(entry >= 0, np.einsum("qd,qed->qe", queries, vectors[entry]), -9.0)
    done[:, :entry.shape[1]] = entry < 0
    q, k = np.nonzero(entry >= 0)
    seen[q, entry[q, k]] = True
    live = np.arange(count)
    while len(live):
        open_ = np.where(done[live], -9.0, near[live])
        step = min(STEP, width)
        best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        chosen = np.take_along_axis(open_, best, 1) > -9.0
        at = live[:, None]
        done[at, best] = True
        found = links[np.where(chosen, ids[at, best], 0)]
        found = np.where(chosen[:, :, None], found, -1).reshape(len(live), -1)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[at, np.maximum(found, 0)]] = -1
        q, k = np.nonzero(found >= 0)
        seen[live[q], found[q, k]] = True
        cosine = np.where(found >= 0, np.einsum("qd,qed->qe", queries[live], vectors[np.maximum(found, 0)]), -9.0)
        all_near = np.concatenate([near[live], cosine], 1)
        top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], found], 1), top, 1)
        near[live] = np.take_along_axis(all_near, top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], found < 0], 1), top, 1)
        live = live[(~done[live] & (near[live] > -9.0)).any(1)]
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def diverse(vectors: np.ndarray, found: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the node than to any chosen before them; places
    that stay free go to the nearest of the others."""
    count, width = found.shape
    chosen = np.full((count, degree), -1, np.int64)
    taken = np.zeros(count, np.int64)
    passed = np.zeros((count, width), bool)
    rows = np.arange(count)
    for k in range(width):
        c = found[:, k]
        to_chosen = np.where(chosen >= 0, np.einsum("qd,qed->qe", vectors[np.maximum(c, 0)], vectors[np.maximum(chosen, 0)]), -9.0).max(1)
        keep = (c >= 0) & (taken < degree) & (to_chosen < near[:, k])
        chosen[rows[keep], taken[keep]] = c[keep]
        taken += keep
        passed[:, k] = (c >= 0) & ~keep
    # The others, nearest first, go to the free places in their order.
    place = taken[:, None] + np.cumsum(passed, axis=1) - 1
    row, k = np.nonzero(passed & (place < degree))
    chosen[row, place[row, k]] = found[row, k]
    return chosen


class Graph:
    def __init__(self, vectors: np.ndarray):
        """Builds the layers. A shard is small enough that a node's nearest candidates come from a product with the
        layer's nodes, block by block; the diverse choice among them and the links back make the small world."""
        n = len(vectors)
        self.vectors = vectors
        draws = np.random.default_rng(7).random(n)
        level = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(np.int64)
        if n:
            level[0] = level.max()
        self.layers = [np.full((n, DEGREE * (1 if k else 2)), -1, np.int64) for k in range(int(level.max()) + 1 if n else 1)]
        for k in range(len(self.layers)):
            here = np.flatnonzero(level >= k)
            wide = min(CANDIDATES, len(here) - 1)
            for at in range(0, len(here) if wide > 0 else 0, BATCH):
                nodes = here[at:at + BATCH]
                cosine = vectors[nodes] @ vectors[here].T
                cosine[np.arange(len(nodes)), np.arange(at, at + len(nodes))] = -9.0
                top = np.argpartition(-cosine, wide - 1, axis=1)[:, :wide]
                # Some far nodes beside the near ones, so that clusters keep ways between them.
                far = np.random.default_rng(at).integers(0, len(here), (len(nodes), FAR))
                far = np.where(here[far] == nodes[:, None], top[:, :1], far)
                both = np.sort(np.concatenate([top, far], axis=1), axis=1)
                twice = np.concatenate([np.zeros((len(nodes), 1), bool), both[:, 1:] == both[:, :-1]], axis=1)
                found, near = np.where(twice, -1, here[both]), np.where(twice, -9.0, np.take_along_axis(cosine, both, 1))
                order = np.argsort(-near, axis=1, kind="stable")
                self.layers[k][nodes] = diverse(vectors, np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1), self.layers[k].shape[1])
            self._link_back(self.layers[k], here)

    def _link_back(self, links: np.ndarray, nodes: np.ndarray) -> None:
        """Add to each node's list those that link to it; lists that overflow are chosen anew."""
        degree = links.shape[1]
        source, target = np.repeat(nodes, degree), links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(heads), BATCH):
            some = slice(at, at + BATCH)
            head, n = heads[some], count[some]
            back = np.full((len(head), int(n.max())), -1, np.int64)
            pick = np.concatenate([np.arange(f, f + c) for f, c in zip(first[some], n)])
            back[np.repeat(np.arange(len(head)), n), np.concatenate([np.arange(c) for c in n])] = source[pick]
            every = np.sort(np.concatenate([links[head], back], 1), axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            cosine = np.where(every >= 0, np.einsum("qd,qed->qe", self.vectors[head], self.vectors[np.maximum(every, 0)]), -9.0)
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :2 * degree]
            links[head] = diverse(self.vectors, np.take_along_axis(every, order, 1), np.take_along_axis(cosine, order, 1), degree)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for links in self.layers[:0:-1]:
            ids, _ = beam(self.vectors, links, queries, entry, 4)
            entry = ids
        return beam(self.vectors, self.layers[0], queries, entry, min(width, len(self.vectors)))
