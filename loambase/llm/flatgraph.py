"""A flat neighbour graph over the vectors of one shard: robust pruning, greedy search, range expansion.

Searches run in step for many queries at once; each step opens the best unopened nodes of every query's
beam. Vectors are unit rows; distances are squared Euclidean ones (2 - 2 cos).
"""

from __future__ import annotations

import numpy as np

#: Neighbours a node keeps, and the slack of the pruning rule, squared.
DEGREE, SLACK = 24, 1.44
#: Size of a beam, nodes opened in a step, queries searched at once.
BEAM, OPEN, TOGETHER = 40, 4, 512


def medoid(units: np.ndarray) -> int:
    """The vector nearest to the mean of all."""
    return int((units @ units.mean(axis=0)).argmax())


def pruned(units: np.ndarray, base: np.ndarray, near: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each node of ``base`` its neighbours (-1: none) out of the candidates ``near`` (a row each, -1: none):
    the nearest first; a candidate that is nearer to one chosen, by the slack, than to the node falls."""
    near = np.sort(near, axis=1)
    bad = (near < 0) | (near == base[:, None])
    bad[:, 1:] |= near[:, 1:] == near[:, :-1]
    vectors = units[near]
    away = 2 - 2 * np.einsum("bd,bcd->bc", units[base], vectors)
    away[bad] = np.inf
    out, row = np.full((len(base), degree), -1, np.int32), np.arange(len(base))
    for r in range(degree):
        best = away.argmin(axis=1)
        ok = np.isfinite(away[row, best])
        if not ok.any():
            break
        out[ok, r] = near[row, best][ok]
        between = 2 - 2 * np.einsum("bd,bcd->bc", vectors[row, best], vectors)
        away[(SLACK * between <= away) & ok[:, None]] = np.inf
        away[row, best] = np.inf
    return out


def greedy(units: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The beam (ids, -1: none) of each query after greedy search from ``start``: at every step the nearest
    unopened nodes of the beam are opened, until none is left."""
    n, row = len(queries), np.arange(len(queries))[:, None]
    ids, away, opened = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf, np.float32), np.ones((n, beam), bool)
    ids[:, 0], away[:, 0], opened[:, 0] = start, 2 - 2 * (queries @ units[start]), False
    seen = np.full((n, len(units)), -1, np.int32)
    seen[:, start] = 0
    while not opened.all():
        open_ = np.argpartition(np.where(opened, np.inf, away), OPEN - 1, axis=1)[:, :OPEN]
        nodes = np.where(opened[row, open_], -1, ids[row, open_])
        opened[row, open_] = True
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(n, -1)
        # Of several mentions of a node, the last one counts.
        place = np.arange(near.shape[1], dtype=np.int32)[None, :]
        fresh = (near >= 0) & (seen[row, near] < 0)
        at, of = np.nonzero(fresh)
        seen[at, near[at, of]] = place[0, of]
        once = seen[at, near[at, of]] == of
        at, of = at[once], of[once]
        new = np.full(near.shape, np.inf, np.float32)
        new[at, of] = 2 - 2 * np.einsum("pd,pd->p", queries[at], units[near[at, of]])
        ids, away, opened = np.hstack([ids, near]), np.hstack([away, new]), np.hstack([opened, ~np.isfinite(new)])
        best = np.argpartition(away, beam - 1, axis=1)[:, :beam]
        ids, away, opened = ids[row, best], away[row, best], opened[row, best]
    ids[~np.isfinite(away)] = -1
    return ids


def _put(units: np.ndarray, graph: np.ndarray, nodes: np.ndarray, beam: np.ndarray) -> None:
    """Give ``nodes`` pruned lists from their beams, and their neighbours the edges back."""
    graph[nodes] = pruned(units, nodes, np.hstack([beam, graph[nodes]]))
    source, target = np.repeat(nodes, graph.shape[1]), graph[nodes].ravel()
    order = np.argsort(target, kind="stable")
    source, target = source[order][target[order] >= 0], target[order][target[order] >= 0]
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
    place = np.arange(len(target)) - np.repeat(heads, np.diff(np.append(heads, len(target))))
    # A target takes its new edges a list's worth at a time.
    for lo in range(0, int(place.max(initial=-1)) + 1, DEGREE):
        part = (place >= lo) & (place < lo + DEGREE)
        to = np.unique(target[part])
        back = np.full((len(to), DEGREE), -1, np.int32)
        back[np.searchsorted(to, target[part]), place[part] - lo] = source[part]
        for at in range(0, len(to), TOGETHER):
            some = to[at : at + TOGETHER]
            graph[some] = pruned(units, some, np.hstack([back[at : at + TOGETHER], graph[some]]))


def build(units: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbour lists, medoid) of a shard. First pass: ever larger batches search the graph so far; second
    pass: every node searches the whole graph, and sees those that came with it."""
    n, units = len(units), units.astype(np.float32)
    graph, start = np.full((n, DEGREE), -1, np.int32), medoid(units)
    order = np.random.default_rng(seed).permutation(n)
    order = np.append(start, order[order != start]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + min(at, TOGETHER)]
        _put(units, graph, batch, greedy(units, graph, start, units[batch]))
        at += len(batch)
    for at in range(0, n, TOGETHER):
        batch = order[at : at + TOGETHER]
        _put(units, graph, batch, greedy(units, graph, start, units[batch]))
    return graph, start


def _fits(units: np.ndarray, queries: np.ndarray, asked: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the asked pairs (a row for each query): which have cosine ``least``, and which come near it."""
    if np.count_nonzero(asked) * 16 > asked.size:
        cosine = units[queries] @ units.T
        return asked & (cosine >= least), asked & (cosine >= 2 * least - 1)
    a, b = np.nonzero(asked)
    cosine = np.einsum("pd,pd->p", units[queries[a]], units[b])
    fits, near = np.zeros_like(asked), np.zeros_like(asked)
    fits[a, b], near[a, b] = cosine >= least, cosine >= 2 * least - 1
    return fits, near


def in_range(units: np.ndarray, source: np.ndarray, target: np.ndarray, graph: np.ndarray, start: int, least: float, beam: int = BEAM) -> np.ndarray:
    """Which of a shard's vectors each one finds at cosine ``least`` or more (a matrix, symmetric): greedy search
    over ``graph`` from the medoid, then the lists of everything found in range, or up to twice as far off, are
    opened until nothing new is. ``source`` and ``target``: the edges of the united graph, both ways."""
    n, single = len(units), units.astype(np.float32)
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
    found = np.zeros((n, n), bool)
    for lo in range(0, n, TOGETHER):
        queries = np.arange(lo, min(n, lo + TOGETHER))
        hits = greedy(single, graph, start, single[queries], beam)
        known = np.zeros((len(queries), n), bool)
        at, of = np.nonzero(hits >= 0)
        known[at, hits[at, of]] = True
        known[np.arange(len(queries)), queries] = True
        asked, checked = known, np.zeros_like(known)
        while True:
            checked |= asked
            fits, near = _fits(units, queries, asked, least)
            found[queries] |= fits
            more = near.any(axis=1)
            if not more.any() or not len(target):
                break
            queries, near, checked = queries[more], near[more], checked[more]
            # A row of bits for each node, the queries that have just found it: its neighbours get them.
            told = np.bitwise_or.reduceat(np.packbits(near.T, axis=1)[source], heads, axis=0)
            asked = np.zeros_like(near)
            asked[:, target[heads]] = np.unpackbits(told, axis=1, count=len(queries)).view(bool).T
            asked &= ~checked
    found |= found.T
    np.fill_diagonal(found, False)
    return found
