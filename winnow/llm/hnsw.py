"""Hierarchical navigable small-world graphs over unit vectors, built and searched in batches with numpy."""

from __future__ import annotations

import numpy as np

#: Neighbours of a node on the lowest layer; half of them above.
DEGREE = 32
BUILD_BEAM = 64
BATCH = 512


class Graph:
    """Nodes are ordered by falling layer, so each layer holds the first nodes up to some number."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers  # neighbours of each node per layer, -1 for none

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes found for each query and their similarity, best first; -1 where there are fewer."""
        entry = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(queries, entry, layer, 4)[0][:, :4]
        return self.beam(queries, entry, 0, beam)

    def beam(self, queries: np.ndarray, entry: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one layer for all queries at once, from given entry nodes."""
        links, vectors, n = self.layers[layer], self.vectors, len(self.layers[layer])
        beam = min(beam, n)
        q = len(queries)
        width = max(2, beam // 16)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)  # the last column takes the padding
        seen[:, n] = True
        ids = np.full((q, beam), n)
        sims = np.full((q, beam), -np.inf, np.float32)
        done = np.ones((q, beam), bool)
        entry = np.where(entry < 0, n, entry)
        ids, sims, done = self._merge(queries, rows, seen, ids, sims, done, entry, n, beam, vectors)
        active = np.arange(q)
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-open_sims, min(width, beam) - 1, axis=1)[:, :width]
            usable = np.take_along_axis(open_sims, pick, 1) > -np.inf
            going = usable.any(axis=1)
            active, pick, usable = active[going], pick[going], usable[going]
            if not len(active):
                break
            chosen = np.where(usable, ids[active[:, None], pick], n)
            part_done = done[active]
            np.put_along_axis(part_done, pick, True, 1)
            near = np.where(chosen[:, :, None] == n, -1, links[np.minimum(chosen, n - 1)])
            near = np.where(near < 0, n, near).reshape(len(active), -1)
            own = np.arange(len(active))[:, None]
            part_seen = seen[active]
            ids[active], sims[active], done[active] = self._merge(
                queries[active], own, part_seen, ids[active], sims[active], part_done, near, n, beam, vectors
            )
            seen[active] = part_seen
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(ids == n, -1, ids), sims

    @staticmethod
    def _merge(queries, rows, seen, ids, sims, done, near, n, beam, vectors):
        """Put unseen nodes into the beams and keep the best of each."""
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[rows, near], n, near)
        most = int((near < n).sum(axis=1).max()) if near.size else 0
        if not most:
            return ids, sims, done
        near = np.sort(near, axis=1)[:, :most]
        seen[rows, near] = True
        found = np.matmul(vectors[np.minimum(near, n - 1)], queries[:, :, None])[:, :, 0]
        found = np.where(near == n, -np.inf, found).astype(np.float32)
        ids = np.concatenate((ids, near), axis=1)
        sims = np.concatenate((sims, found), axis=1)
        done = np.concatenate((done, near == n), axis=1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        return tuple(np.take_along_axis(x, best, 1) for x in (ids, sims, done))


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the row than to a better one kept;
    free places go to the best of the others."""
    q, e = ids.shape
    if e <= degree:
        return np.concatenate((ids, np.full((q, degree - e), -1)), axis=1)
    held = vectors[np.maximum(ids, 0)]
    between = np.matmul(held, held.transpose(0, 2, 1))
    kept = np.zeros((q, e), bool)
    closest = np.full((q, e), -np.inf, np.float32)  # of each candidate to those kept
    count = np.zeros(q, np.int64)
    for k in range(e):
        take = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (count < degree)
        kept[:, k] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, :, k]), closest)
    rank = np.where(kept, 0, 1) * e + np.arange(e)
    rank = np.where(ids < 0, 3 * e, rank)
    best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(ids, best, 1)


def _connect(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Link new nodes to the chosen ones and back; full lists keep a diverse part."""
    degree = links.shape[1]
    links[new] = chosen
    source = np.repeat(new, degree)
    target = chosen.ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    sims = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(start, count)
    ok = rank < degree
    added = np.full((len(nodes), degree), -1)
    added[np.repeat(np.arange(len(nodes)), count)[ok], rank[ok]] = source[ok]
    for begin in range(0, len(nodes), BATCH):
        part = nodes[begin : begin + BATCH]
        ids = np.sort(np.concatenate((links[part], added[begin : begin + BATCH]), axis=1), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.matmul(vectors[np.maximum(ids, 0)], vectors[part][:, :, None])[:, :, 0]
        sims = np.where(ids < 0, -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        full = (ids >= 0).sum(axis=1) > degree
        links[part] = ids[:, :degree]
        if full.any():
            links[part[full]] = _diverse(vectors, ids[full], sims[full], degree)


def build(vectors: np.ndarray, draws: np.ndarray) -> tuple[Graph, np.ndarray]:
    """The graph of unit vectors, and the order of its nodes. ``draws`` in (0, 1) give the layers.

    Nodes come in batches that are never larger than what is there already; a batch is linked to nodes
    found by beam search and to nodes of the batch itself.
    """
    layer_of = np.floor(-np.log(draws) / np.log(DEGREE / 2)).astype(int)
    order = np.lexsort((draws, -layer_of))
    vectors, layer_of = np.ascontiguousarray(vectors[order], np.float32), layer_of[order]
    top = int(layer_of[0])
    layers: list[np.ndarray] = [np.zeros((0, 0), np.int64)] * (top + 1)
    for layer in range(top, -1, -1):
        n = int((layer_of >= layer).sum())
        degree = DEGREE if layer == 0 else DEGREE // 2
        links = np.full((n, degree), -1)
        done = 0
        while done < n:
            size = min(n - done, BATCH, max(done, 64))
            new = np.arange(done, done + size)
            own = vectors[new]
            inner = own @ own.T
            np.fill_diagonal(inner, -np.inf)
            nearest = np.argsort(-inner, axis=1, kind="stable")[:, : min(degree, size - 1)]
            ids, sims = nearest + done, np.take_along_axis(inner, nearest, 1)
            if done:
                part = Graph(vectors, [*layers[:layer], links[:done], *layers[layer + 1 :]])
                entry = np.zeros((size, 1), np.int64)
                for above in range(top, layer, -1):
                    if len(layers[above]) and done > 0:
                        entry = part.beam(own, entry, above, 4)[0][:, :4]
                entry = np.where(entry < done, entry, 0)
                found, near = part.beam(own, entry, layer, BUILD_BEAM)
                ids, sims = np.concatenate((ids, found), axis=1), np.concatenate((sims, near), axis=1)
            best = np.argsort(-np.where(ids < 0, -np.inf, sims), axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            _connect(vectors, links, new, _diverse(vectors, ids, sims, degree))
            done += size
        layers[layer] = links
    return Graph(vectors, layers), order
