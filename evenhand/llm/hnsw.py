"""Hierarchical navigable small-world graph as flat arrays, built and searched in numpy.

Points are ordered by level, highest first, so that layer ``l`` is the first ``n_l``
points and its links one array [n_l, width] of point numbers, -1 where there is
none. Points are unit vectors and nearness is the inner product. Many queries walk
the graph side by side: one step gathers the links of all their current points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 16  # links of a point in the upper layers, twice as many in layer 0
BUILD_BEAM = 48
FIRST = 256  # points that are compared one by one before the graph is walked
BATCH = 1024  # points added side by side
STEP = 4  # points of a beam that are opened at a time
MARKS = 1 << 21  # entries of the table of visited points of the queries that walk together


@dataclass
class Graph:
    points: np.ndarray  # [n, d] unit vectors, float32, ordered by level
    layers: list[np.ndarray]  # links by layer, layer 0 first


def levels(n: int, seed: int) -> np.ndarray:
    """Random level of each point, geometric with ratio 1 / WIDTH."""
    return np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(WIDTH)).astype(np.int64)


def pick(points: np.ndarray, near: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Links from candidates, nearest first: one is passed over if a chosen one is nearer to it than the point is.

    ``near`` is [rows, c] with -1 for none and ``sims`` their nearness in falling order.
    Places that stay free are filled with the nearest that were passed over.
    """
    rows, c = near.shape
    found = np.full((rows, width), -1, np.int32)
    for start in range(0, rows, 512):
        ids, sim = near[start:start + 512], sims[start:start + 512]
        there = ids >= 0
        vectors = points[np.maximum(ids, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        n = np.zeros(len(ids), np.int64)
        for j in range(c):
            shadowed = (chosen & (between[:, j] > sim[:, j, None])).any(axis=1)
            take = there[:, j] & ~shadowed & (n < width)
            chosen[:, j] = take
            n += take
        order = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :width]
        kept = np.take_along_axis(np.where(there, ids, -1), order, axis=1)
        found[start:start + 512, :kept.shape[1]] = kept
    return found


def top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest of each row in falling order."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1)


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int
         ) -> tuple[np.ndarray, np.ndarray]:
    """(nearness, point) [queries, beam] of the best points that a beam search of one layer meets, -1 for none.

    ``entries`` [queries, e] are the points to start from, distinct within a row, -1 for none.
    """
    n = len(links)
    sims_out = np.full((len(queries), beam), -np.inf, np.float32)
    ids_out = np.full((len(queries), beam), -1, np.int32)
    together = max(16, min(512, MARKS // max(n, 1)))
    for start in range(0, len(queries), together):
        q = queries[start:start + together]
        entry = entries[start:start + together].astype(np.int32)
        sim = np.where(entry >= 0, np.einsum("qed,qd->qe", points[np.maximum(entry, 0)], q), -np.inf).astype(np.float32)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        width = min(beam, entry.shape[1])
        sims[:, :width], ids[:, :width] = top(sim, entry, width)
        opened = np.zeros(ids.shape, bool)
        marks = np.zeros(len(q) * n, np.int32)
        at, slot = np.nonzero(ids >= 0)
        marks[at * n + ids[at, slot]] = 1
        live = np.arange(len(q))
        while len(live):
            closed = ~opened[live] & (ids[live] >= 0)
            busy = closed.any(axis=1)
            live, closed = live[busy], closed[busy]
            if not len(live):
                break
            slots = np.argsort(~closed, axis=1, kind="stable")[:, :STEP]
            open_now = np.take_along_axis(closed, slots, axis=1)
            opened[live[:, None], slots] |= open_now
            from_points = np.where(open_now, np.take_along_axis(ids[live], slots, axis=1), -1)
            met = np.where((from_points >= 0)[:, :, None], links[np.maximum(from_points, 0)], -1).reshape(len(live), -1)
            row, column = np.nonzero(met >= 0)
            point = met[row, column]
            key = live[row] * n + point
            fresh = marks[key] == 0
            row, column, point, key = row[fresh], column[fresh], point[fresh], key[fresh]
            stamp = np.arange(1, len(key) + 1, dtype=np.int32)
            marks[key] = stamp
            once = marks[key] == stamp  # a point met twice in one step counts once
            row, column, point = row[once], column[once], point[once]
            new_sims = np.full(met.shape, -np.inf, np.float32)
            new_sims[row, column] = np.einsum("id,id->i", points[point], q[live[row]])
            all_sims = np.concatenate([sims[live], new_sims], axis=1)
            all_ids = np.concatenate([ids[live], np.where(np.isfinite(new_sims), met, -1)], axis=1)
            all_opened = np.concatenate([opened[live], np.zeros(met.shape, bool)], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_sims, order, axis=1)
            ids[live] = np.take_along_axis(all_ids, order, axis=1)
            opened[live] = np.take_along_axis(all_opened, order, axis=1)
        sims_out[start:start + together], ids_out[start:start + together] = sims, ids
    return sims_out, ids_out


def descend(graph_points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, down_to: int) -> np.ndarray:
    """Points to start from in layer ``down_to``: the best few of the layer above, found from the top."""
    entries = np.zeros((len(queries), 1), np.int32)
    for layer in range(len(layers) - 1, down_to, -1):
        if len(layers[layer]):
            _, entries = walk(graph_points, layers[layer], queries, entries, STEP)
    return entries


def nearest_within(points: np.ndarray, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearness, point) of the ``k`` nearest of each of the points ``first`` to ``last`` among themselves."""
    sims = points[first:last] @ points[first:last].T
    np.fill_diagonal(sims, -np.inf)
    k = min(k, last - first)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    sims, ids = top(np.take_along_axis(sims, best, axis=1), (best + first).astype(np.int32), k)
    return sims, np.where(np.isfinite(sims), ids, -1)


def link_back(points: np.ndarray, links: np.ndarray, first: int, last: int) -> None:
    """Add the opposite links of the points ``first`` to ``last``; a point with too many picks anew."""
    width = links.shape[1]
    source, slot = np.nonzero(links[first:last] >= 0)
    target = links[first + source, slot]
    source = (source + first).astype(np.int32)
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(target)])
    for a in range(0, len(starts), 2048):
        at = target[starts[a:a + 2048]]
        size = sizes[a:a + 2048]
        most = min(int(size.max()), 2 * width)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(len(at)), size)
        new = source[starts[a]:starts[a] + size.sum()]
        if size.max() > most:  # many points chose one target: the nearest of them are its candidates
            sim = np.einsum("id,id->i", points[new], points[at[row]])
            rank = np.lexsort((-sim, row))
            new = new[rank]
        fits = place < most
        incoming = np.full((len(at), most), -1, np.int32)
        incoming[row[fits], place[fits]] = new[fits]
        both = np.concatenate([links[at], incoming], axis=1)
        twice = (incoming[:, :, None] == links[at][:, None, :]).any(axis=2)
        both[:, width:][twice] = -1
        sims = np.where(both >= 0, np.einsum("rcd,rd->rc", points[np.maximum(both, 0)], points[at]), -np.inf)
        sims, both = top(sims, both, both.shape[1])
        spare = (both >= 0).sum(axis=1) <= width
        links[at[spare]] = both[spare, :width]
        if (~spare).any():
            links[at[~spare]] = pick(points, both[~spare], sims[~spare], width)


def build(vectors: np.ndarray, seed: int = 0) -> tuple[Graph, np.ndarray]:
    """The graph of unit vectors and the order in which it holds them."""
    level = levels(len(vectors), seed)
    order = np.argsort(-level, kind="stable")
    points = np.ascontiguousarray(vectors[order], np.float32)
    level = level[order]
    layers: list[np.ndarray] = []
    for layer in range(int(level.max(initial=0)), -1, -1):
        n = int((level >= layer).sum())
        width = WIDTH * (2 if layer == 0 else 1)
        links = np.full((n, width), -1, np.int32)
        above = [np.zeros((0, 0), np.int32)] * (layer + 1) + layers
        done = min(n, FIRST)
        if done > 1:
            sims, near = nearest_within(points, 0, done, BUILD_BEAM)
            links[:done] = pick(points, near, sims, width)
            link_back(points, links, 0, done)
        while done < n:
            last = min(n, done + min(BATCH, max(done // 2, 1)))
            entries = descend(points, above, points[done:last], layer)
            entries = np.where(entries < done, entries, -1)  # points that this layer has not linked yet
            entries[(entries < 0).all(axis=1), 0] = 0
            sims, near = walk(points, links[:done], points[done:last], entries, BUILD_BEAM)
            own_sims, own = nearest_within(points, done, last, WIDTH)
            sims, near = top(np.concatenate([sims, own_sims], axis=1), np.concatenate([near, own], axis=1), BUILD_BEAM)
            links[done:last] = pick(points, near, sims, width)
            link_back(points, links, done, last)
            done = last
        layers.insert(0, links)
    return Graph(points, layers), order


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearness, point) [queries, beam] in falling order, -1 for none."""
    if not len(graph.points):
        return np.full((len(queries), beam), -np.inf, np.float32), np.full((len(queries), beam), -1, np.int32)
    queries = np.ascontiguousarray(queries, np.float32)
    entries = descend(graph.points, graph.layers, queries, 0)
    return walk(graph.points, graph.layers[0], queries, entries, beam)
