"""A hierarchical navigable small-world graph of one shard, searched for many queries at once.

Malkov and Yashunin's graph, with the beams of a batch of queries held side by side in arrays. Nodes that come
first have the most levels, so a level's links are an array of its own nodes only, and node 0 is the entry; the
order of the nodes should have nothing to do with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LINKS, SPARE = 12, 8
#: Bytes that one step over a batch of queries takes at most.
_SPACE = 32 << 20


def _batch(x: np.ndarray, width: int) -> int:
    """Queries whose beams fit the space of a step: marks, four nodes' links with their vectors, and the beam."""
    return max(1, min(256, _SPACE // (len(x) + 64 * LINKS * x.shape[1] + 48 * width)))


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that each query's beam reaches from its entries: ids (-1: none) and similarities."""
    n_q, step = len(q), min(4, width)
    ids = np.full((n_q, width), -1, np.int32)
    sims = np.full((n_q, width), -np.inf, np.float32)
    done = np.ones((n_q, width), bool)
    seen = np.zeros((n_q, len(links)), bool)
    k = min(width, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    first = np.where(ids[:, :k] >= 0, ids[:, :k], 0)
    done[:, :k] = ids[:, :k] < 0
    sims[:, :k] = np.where(done[:, :k], -np.inf, np.einsum("bd,bkd->bk", q, x[first]))
    np.put_along_axis(seen, first, True, 1)
    open_ = np.flatnonzero(~done.all(1))
    while len(open_):
        near = np.where(done[open_], -np.inf, sims[open_])
        pick = np.argpartition(-near, step - 1, axis=1)[:, :step]
        fresh = np.take_along_axis(near, pick, 1) > -np.inf
        own_done = done[open_]
        np.put_along_axis(own_done, pick, True, 1)
        nodes = np.where(fresh, np.take_along_axis(ids[open_], pick, 1), 0)
        nb = np.where(fresh[:, :, None], links[nodes], -1).reshape(len(open_), -1)
        nb.sort(axis=1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        at = np.where(nb >= 0, nb, 0)
        good = (nb >= 0) & ~seen[open_[:, None], at]
        rows, cols = np.nonzero(good)
        seen[open_[rows], nb[rows, cols]] = True
        sim = np.full(nb.shape, -np.inf, np.float32)
        sim[rows, cols] = np.einsum("kd,kd->k", q[open_[rows]], x[nb[rows, cols]])
        all_sims = np.concatenate([sims[open_], sim], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[open_] = np.take_along_axis(np.concatenate([ids[open_], nb], 1), top, 1)
        sims[open_] = np.take_along_axis(all_sims, top, 1)
        done[open_] = np.take_along_axis(np.concatenate([own_done, ~good], 1), top, 1)
        open_ = open_[~done[open_].all(1)]
    return ids, sims


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates up to ``m``: first those nearer to the row's node than to any chosen one, then the nearest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    rows = np.arange(len(ids))
    chosen = np.zeros(ids.shape, bool)
    held = np.zeros((len(ids), m, x.shape[1]), np.float32)
    count = np.zeros(len(ids), np.int64)
    empty = np.full((len(ids), m), -np.inf, np.float32)
    for c in range(ids.shape[1]):
        valid = (sims[:, c] > -np.inf) & (count < m)
        if not valid.any():
            break
        v = x[np.where(valid, ids[:, c], 0)]
        closest = (np.einsum("bd,bmd->bm", v, held) + np.where(np.arange(m) < count[:, None], 0, empty)).max(1)
        take = valid & (closest < sims[:, c])
        held[rows[take], count[take]] = v[take]
        count[take] += 1
        chosen[take, c] = True
    rank = np.where(chosen, 0, 1) + np.where(sims > -np.inf, 0, 2)
    best = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.where(np.take_along_axis(sims, best, 1) > -np.inf, np.take_along_axis(ids, best, 1), -1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1).astype(np.int32)


def _link_back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds source to the links of target, keeping the best of each target."""
    most = links.shape[1]
    sim = np.einsum("kd,kd->k", x[source], x[target])
    order = np.lexsort((-sim, target))
    source, target, sim = source[order], target[order], sim[order]
    nodes, start = np.unique(target, return_index=True)
    rank = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
    keep = rank < most
    row = np.searchsorted(nodes, target[keep])
    new_ids = np.full((len(nodes), most), -1, np.int32)
    new_ids[row, rank[keep]] = source[keep]
    ids = np.concatenate([links[nodes], new_ids], 1)
    step = max(1, (1 << 16) // x.shape[1])
    for at in range(0, len(nodes), step):
        part = slice(at, at + step)
        own = ids[part]
        sims = np.einsum("bd,bkd->bk", x[nodes[part]], x[np.where(own >= 0, own, 0)])
        links[nodes[part]] = _select(x, own, np.where(own >= 0, sims, -np.inf).astype(np.float32), most)


def _connect(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Links with which every node is reached from the entry: a lost node hangs on the nearest one that has room."""
    links = np.concatenate([links, np.full((len(links), SPARE), -1, np.int32)], 1)
    room = np.full(len(x), SPARE)
    seen = np.zeros(len(x), bool)
    front = np.array([0])
    while True:
        while len(front):
            seen[front] = True
            near = np.unique(links[front])
            near = near[near >= 0]
            front = near[~seen[near]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return links
        free = np.flatnonzero(seen & (room > 0))
        there, step = x[free].T, max(1, _SPACE // (8 * len(free)))
        best = np.concatenate([free[(x[lost[at : at + step]] @ there).argmax(1)] for at in range(0, len(lost), step)])
        order = np.argsort(best, kind="stable")
        lost, best = lost[order], best[order]
        _, start, count = np.unique(best, return_index=True, return_counts=True)
        rank = np.arange(len(best)) - np.repeat(start, count)
        keep = rank < room[best]
        lost, best, rank = lost[keep], best[keep], rank[keep]
        links[best, links.shape[1] - room[best] + rank] = lost
        np.subtract.at(room, best, 1)
        front = lost


def build(x: np.ndarray, width: int = 48) -> list[np.ndarray]:
    """Links of all levels of the graph of unit vectors ``x``, the top level last."""
    n, most = len(x), _batch(x, width)
    rng = np.random.Generator(np.random.PCG64(11))
    level = -np.sort(-np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(np.int64), 8))
    top = int(level[0])
    order = np.concatenate([[0], 1 + rng.permutation(n - 1)])
    levels = [np.full((np.count_nonzero(level >= k), LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
    at = 1
    while at < n:
        batch = order[at : at + min(most, max(8, at))]
        at += len(batch)
        q = x[batch]
        start = np.zeros((len(batch), 1), np.int32)
        peer = q @ q.T
        np.fill_diagonal(peer, -np.inf)
        for k in range(top, -1, -1):
            ids, sims = beam(x, levels[k], q, start, width if (level[batch] >= k).any() else 4)
            best = np.argsort(-sims, axis=1)[:, :4]
            start = np.take_along_axis(ids, best, 1)
            mine = np.flatnonzero(level[batch] >= k)
            if not len(mine):
                continue
            near = min(width, len(mine))
            peers = peer[np.ix_(mine, mine)]
            close = np.argpartition(-peers, near - 1, axis=1)[:, :near]
            all_ids = np.concatenate([ids[mine], batch[mine][close]], 1)
            all_sims = np.concatenate([sims[mine], np.take_along_axis(peers, close, 1)], 1)
            nb = _select(x, all_ids, all_sims, LINKS)
            levels[k][batch[mine], :LINKS] = nb
            rows, cols = np.nonzero(nb >= 0)
            _link_back(x, levels[k], batch[mine][rows], nb[rows, cols])
    levels[0] = _connect(x, levels[0])
    return levels


def search(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, width: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) of similarity ``least`` or more, a bounded number at a time. A beam that holds nothing less
    is doubled until it does; where that would be more work than the whole shard, its query is compared with that."""
    whole = max(1, _SPACE // (64 * len(x)))
    queue = [(np.arange(len(q)), None, width)]
    while queue:
        rows, start, now = queue.pop()
        exact = now >= len(x) or now > max(width, len(x) // 128)
        size = whole if exact else _batch(x, now)
        if len(rows) > size:
            queue += [(rows[at : at + size], start if start is None else start[at : at + size], now) for at in range(0, len(rows), size)]
            continue
        if exact:
            r, c = np.nonzero(q[rows] @ x.T >= least)
            yield rows[r], c
            continue
        if start is None:
            start = np.zeros((len(rows), 1), np.int32)
            for links in levels[:0:-1]:
                ids, sims = beam(x, links, q[rows], start, 4)
                start = np.take_along_axis(ids, np.argsort(-sims, axis=1), 1)
        ids, sims = beam(x, levels[0], q[rows], start, now)
        full = sims.min(1) >= least
        r, c = np.nonzero((sims >= least) & ~full[:, None])
        yield rows[r], ids[r, c].astype(np.int64)
        if full.any():
            queue.append((rows[full], ids[full], 2 * now))
