"""A robust-pruned flat graph over vectors: building it, joining up loose parts, and range-expanding greedy search."""

from __future__ import annotations

import numpy as np

#: Out-edges of a node, others that they are pruned from, candidates that a search keeps, and by how much farther an edge must be to be pruned.
DEGREE, POOL, BEAM, SLACK = 20, 48, 32, 1.5
#: Nearest others of a node that always have an edge to it.
KEPT = 3
#: Queries that walk the graph together, and edges that they follow at once when they widen; both bound memory.
TOGETHER, FOLLOWED = 256, 1 << 20


def medoid(vectors: np.ndarray) -> int:
    """The node nearest to the mean direction."""
    return int(np.argmax(vectors @ vectors.mean(axis=0)))


def _fresh(vectors: np.ndarray, queries: np.ndarray, visited: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the (query, node) pairs those not met before, once each and in order, marked as met, with their cosines."""
    n = len(vectors)
    keys = rows * n + ids
    keys = np.unique(keys[~visited.ravel()[keys]])
    visited.ravel()[keys] = True
    rows, ids = np.divmod(keys, n)
    return rows, ids, np.einsum("ij,ij->i", queries[rows], vectors[ids])


def walk(vectors: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, radius, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of all that searches over the graph find in range.

    The searches take their steps together. Each starts from its row of ``starts`` and opens its best unopened node until
    all of its ``beam`` best are open. Then it widens: all nodes in range are opened too, and those that they lead to, as
    long as any is in range. ``radius(rows, nodes)`` is the cosine from which a node is in range of a query. ``edges``
    and ``starts`` hold -1 where there are fewer.
    """
    q, n = len(queries), len(vectors)
    visited = np.zeros((q, n), bool)
    ids, close, opened = np.full((q, beam), -1, np.int64), np.full((q, beam), -2.0), np.ones((q, beam), bool)
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0, queries.dtype))]

    def meet(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The new ones of these pairs; those in range are kept."""
        rows, nodes, value = _fresh(vectors, queries, visited, rows, nodes)
        near = value >= radius(rows, nodes)
        found.append((rows[near], nodes[near], value[near]))
        return rows, nodes, value

    def rank(rows: np.ndarray, nodes: np.ndarray, value: np.ndarray) -> None:
        """Puts newly met nodes, in order of their queries, into the queries' beams."""
        changed, at = np.unique(rows, return_index=True)
        counts = np.diff(np.append(at, len(rows)))
        place = np.arange(len(rows)) - np.repeat(at, counts)
        own = np.repeat(np.arange(len(changed)), counts)
        more_ids, more_close = np.full((len(changed), counts.max()), -1, np.int64), np.full((len(changed), counts.max()), -2.0)
        more_ids[own, place], more_close[own, place] = nodes, value
        all_ids, all_close = np.concatenate([ids[changed], more_ids], axis=1), np.concatenate([close[changed], more_close], axis=1)
        all_open = np.concatenate([opened[changed], more_ids < 0], axis=1)
        top = np.argsort(-all_close, axis=1, kind="stable")[:, :beam]
        ids[changed], close[changed], opened[changed] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_close, all_open))

    r, c = np.nonzero(starts >= 0)
    rank(*meet(r, starts[r, c]))
    while True:
        best = np.where(opened, -3.0, close).argmax(axis=1)
        alive = np.nonzero(~opened[np.arange(q), best])[0]
        if not len(alive):
            break
        best = best[alive]
        opened[alive, best] = True
        near = edges[ids[alive, best]]
        r, c = np.nonzero(near >= 0)
        rows, nodes, value = meet(alive[r], near[r, c])
        if len(rows):
            rank(rows, nodes, value)
    front = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    most = max(1, FOLLOWED // max(1, edges.shape[1]))
    while len(front[0]):
        before = len(found)
        for at in range(0, len(front[0]), most):
            near = edges[front[1][at : at + most]]
            r, c = np.nonzero(near >= 0)
            meet(front[0][at : at + most][r], near[r, c])
        front = tuple(np.concatenate(x) for x in zip(*found[before:], strict=True))
    rows, nodes, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, nodes, value


def prune(vectors: np.ndarray, nodes: np.ndarray, pool: np.ndarray, slack: float = SLACK, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning of each node's ``pool`` (-1 where empty): the nearest stays, and what is much nearer to it than to the node goes; again and again."""
    valid = (pool >= 0) & (pool != nodes[:, None])
    of_pool = vectors[np.where(valid, pool, 0)]
    away = np.where(valid, 1 - np.einsum("ijk,ik->ij", of_pool, vectors[nodes]), np.inf)
    between = 1 - of_pool @ of_pool.transpose(0, 2, 1)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = away.argmin(axis=1)
        some = np.isfinite(away[rows, first])
        if not some.any():
            break
        out[some, k] = pool[rows[some], first[some]]
        away[(slack * between[rows, first] <= away) & some[:, None]] = np.inf
        away[rows[some], first[some]] = np.inf
    return out


def _padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(lists), width), -1, np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def build(vectors: np.ndarray) -> np.ndarray:
    """Edges of a graph over the unit ``vectors`` of one shard, whose size is bounded.

    A node's edges are pruned from its nearest POOL others, found block by block; edges are then made mutual and pruned
    again where a node has too many. Its KEPT nearest lead back to a node even so, and loose parts are joined up.
    """
    n = len(vectors)
    if n <= DEGREE:
        return np.array([[j if j != i else -1 for j in range(n)] for i in range(n)], np.int64).reshape(n, n)
    edges = np.empty((n, DEGREE), np.int64)
    for at in range(0, n, TOGETHER):
        nodes = np.arange(at, min(n, at + TOGETHER))
        close = vectors[nodes] @ vectors.T
        close[np.arange(len(nodes)), nodes] = -np.inf
        pool = np.argpartition(-close, min(POOL, n - 1) - 1, axis=1)[:, :POOL]
        edges[nodes] = prune(vectors, nodes, pool)
    back = edges[:, :KEPT]
    edges = _mutual(vectors, edges)
    out = np.concatenate([edges[edges >= 0], np.repeat(np.arange(n), KEPT)[back.ravel() >= 0]])
    owner = np.concatenate([np.nonzero(edges >= 0)[0], back[back >= 0]])
    owner, out = np.divmod(np.unique(owner * n + out), n)
    edges = local_edges(np.arange(n), out, np.bincount(owner, minlength=n))
    return _joined(vectors, edges, medoid(vectors))


def _mutual(vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each node's edges and those that lead to it, pruned to the degree; of very many the nearest are considered."""
    n = len(vectors)
    rows, columns = np.nonzero(edges >= 0)
    a = np.concatenate([rows, edges[rows, columns]])
    b = np.concatenate([edges[rows, columns], rows])
    a, b = np.divmod(np.unique(a * n + b), n)
    closeness = np.einsum("ij,ij->i", vectors[a], vectors[b])
    order = np.lexsort((-closeness, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < 4 * DEGREE
    pool = np.full((n, 4 * DEGREE), -1, np.int64)
    pool[a[keep], place[keep]] = b[keep]
    out = np.empty((n, DEGREE), np.int64)
    for at in range(0, n, TOGETHER):
        nodes = np.arange(at, min(n, at + TOGETHER))
        out[nodes] = prune(vectors, nodes, pool[nodes])
    return out


def reached(edges: np.ndarray, start: int) -> np.ndarray:
    known = np.zeros(len(edges), bool)
    known[start], front = True, np.array([start])
    while len(front):
        front = np.unique(edges[front])
        front = front[front >= 0]
        front = front[~known[front]]
        known[front] = True
    return known


def _joined(vectors: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """``edges`` with extra ones so that every node can be reached from ``start``: to each loose node from its nearest reached one."""
    extra: dict[int, list[int]] = {}
    known = reached(edges, start)
    while not known.all():
        loose, inside = int(np.nonzero(~known)[0][0]), np.nonzero(known)[0]
        nearest = int(inside[np.argmax(vectors[inside] @ vectors[loose])])
        extra.setdefault(nearest, []).append(loose)
        known |= reached(edges, loose)
    if not extra:
        return edges
    lists = [np.concatenate([row[row >= 0], extra.get(k, [])]).astype(np.int64) for k, row in enumerate(edges)]
    return _padded(lists, max(map(len, lists)))


def local_edges(ids: np.ndarray, near: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edges by place, -1 where there are fewer, of lists of ids in a row; ids that are not among the ascending ``ids`` are left out."""
    owner = np.repeat(np.arange(len(ids)), lengths)
    at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
    own = ids[at] == near
    owner, at = owner[own], at[own]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.full((len(ids), int(place.max(initial=0)) + 1), -1, np.int64)
    out[owner, place] = at
    return out


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest that the links a - b connect it with."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def leaders(vectors: np.ndarray, least: float) -> np.ndarray:
    """For each vector the place of its leader: the first leader with a cosine of ``least`` or more, or itself."""
    out, found = np.full(len(vectors), -1, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(vectors), TOGETHER):
        block = vectors[at : at + TOGETHER]
        if len(found):
            close = block @ vectors[found].T
            first = close.argmax(axis=1)
            ok = close[np.arange(len(block)), first] >= least
            out[at : at + len(block)][ok] = found[first[ok]]
        for k in np.nonzero(out[at : at + len(block)] < 0)[0]:
            if out[at + k] >= 0:
                continue
            free = np.nonzero(out[at : at + len(block)] < 0)[0]
            joins = free[block[free] @ block[k] >= least]
            out[at + joins] = at + k
            out[at + k] = at + k
            found = np.append(found, at + k)
    return out


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """``k`` unit centres of a sample of unit vectors by spherical k-means."""
    random = np.random.default_rng(seed)
    out = sample[random.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        out = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], out)
    return out
