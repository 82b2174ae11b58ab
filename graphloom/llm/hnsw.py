"""A hierarchical navigable small-world graph in flat arrays, built and searched for many vectors at once in numpy.

Vectors have length one; similarity is the dot product. Level 0 holds all nodes, each level above a random share of
the one below. ``links[level]`` is an integer array with a row of neighbours per node of the shard (-1: none).
"""

from __future__ import annotations

import io
import math

import numpy as np

NONE = -1
#: Nodes that are inserted together, and queries whose walks share a frontier.
TOGETHER, GROUP = 2048, 128


class Graph:
    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry
        self.near: tuple[np.ndarray, np.ndarray] | None = None  # nodes and similarities, where asked for when built

    # -- search ---------------------------------------------------------------------------------------------------

    def _descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """The nodes that greedy walks on the levels above ``down_to`` end at."""
        at = np.full(len(queries), self.entry, np.int64)
        best = queries @ self.vectors[self.entry]
        for level in range(len(self.links) - 1, down_to, -1):
            moving = np.arange(len(queries))
            while len(moving):
                near = self.links[level][at[moving]]
                sims = np.einsum("bd,bmd->bm", queries[moving], self.vectors[near])
                sims[near == NONE] = -np.inf
                k = sims.argmax(axis=1)
                value = sims[np.arange(len(moving)), k]
                better = value > best[moving]
                moved = moving[better]
                at[moved], best[moved] = near[better, k[better]], value[better]
                moving = moved
        return at

    def _beam(self, queries: np.ndarray, start: np.ndarray, ef: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes that walks from ``start`` meet on a level, best first (-1 and -inf where fewer).

        Walks that start near each other go together: the open nodes of all their lists are expanded at once, and what
        they link to is compared with every query of the group in one product of matrices.
        """
        ids = np.full((len(queries), ef), NONE, np.int32)
        sims = np.full((len(queries), ef), -np.inf, np.float32)
        order = np.argsort(start, kind="stable")
        met, flag = np.zeros(len(self.vectors), bool), np.zeros(len(self.vectors), bool)
        for at in range(0, len(order), GROUP):
            own = order[at : at + GROUP]
            ids[own], sims[own] = self._walk(queries[own], np.unique(start[own]), ef, self.links[level], met, flag)
        return ids, sims

    def _walk(self, queries: np.ndarray, new: np.ndarray, ef: int, links: np.ndarray, met: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of one group; ``met`` and ``flag`` are clear before and after."""
        n, vectors = len(queries), self.vectors
        ids, sims = np.full((n, ef), NONE, np.int32), np.full((n, ef), -np.inf, np.float32)
        seen, opened = [], []
        while len(new):
            met[new] = True
            seen.append(new)
            value = queries @ vectors[new].T
            useful = (value > sims.min(axis=1, keepdims=True)).any(axis=0)
            if not useful.all():
                new, value = new[useful], value[:, useful]
            both = np.concatenate([sims, value], axis=1)
            keep = np.argpartition(both, both.shape[1] - ef, axis=1)[:, both.shape[1] - ef :]
            sims = np.take_along_axis(both, keep, 1)
            ids = np.where(keep < ef, np.take_along_axis(ids, np.minimum(keep, ef - 1), 1), np.append(new, NONE)[np.clip(keep - ef, -1, len(new))])
            flag[ids[sims > -np.inf]] = True
            for old in opened:
                flag[old] = False
            open_ = np.flatnonzero(flag)
            flag[open_] = False
            opened.append(open_)
            near = links[open_].ravel()
            near = near[near != NONE]
            flag[near[~met[near]]] = True
            new = np.flatnonzero(flag)
            flag[new] = False
        for old in seen:
            met[old] = False
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), NONE), sims

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of about the ``k`` most similar vectors for each query, best first."""
        out = [self._beam(q, self._descend(q, 0), max(k, ef), 0) for q in (queries[i : i + TOGETHER] for i in range(0, len(queries), TOGETHER))]
        if not out:
            return np.zeros((0, k), np.int64), np.zeros((0, k), np.float32)
        return np.concatenate([i[:, :k] for i, _ in out]), np.concatenate([s[:, :k] for _, s in out])

    # -- building -------------------------------------------------------------------------------------------------

    @staticmethod
    def build(vectors: np.ndarray, m: int = 8, ef: int = 24, seed: int = 7, keep: int = 0) -> Graph:
        """Insert the vectors in batches that never outnumber the nodes already there; deterministic.

        Every insertion searches the graph for the new vector's neighbours. With ``keep`` what these searches find
        counts for both ends, and the ``keep`` best of each node are left in ``near``: the graph's answer for its own
        nodes, without searching for them again.
        """
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(np.int64), 8)
        order = np.argsort(-levels, kind="stable")  # the highest first, so that the entry never changes
        top = int(levels.max(initial=0))
        graph = Graph(vectors, [np.full((n, 2 * m if level == 0 else m), NONE, np.int32) for level in range(top + 1)], int(order[0]) if n else 0)
        if keep:
            graph.near = np.full((n, keep), NONE, np.int32), np.full((n, keep), -np.inf, np.float32)
        done = 1
        while done < n:
            batch = order[done : done + min(done, TOGETHER)]
            for level in range(top + 1):
                inside = batch[levels[batch] >= level]
                if len(inside):
                    graph._insert(inside, level, ef, m)
            done += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, level: int, ef: int, m: int) -> None:
        queries = self.vectors[batch]
        found, sims = self._beam(queries, self._descend(queries, level), ef, level)
        own = queries @ queries.T  # the others of the batch
        np.fill_diagonal(own, -np.inf)
        k = min(ef, len(batch))
        mates = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([found, batch[mates]], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(own, mates, 1)], axis=1)
        ids[(ids == batch[:, None]) | (sims == -np.inf)] = NONE
        if level == 0 and self.near:
            self._remember(batch, ids, np.where(ids == NONE, -np.inf, sims))
        chosen = self._diverse(ids, np.where(ids == NONE, -np.inf, sims), m)
        self.links[level][batch, : chosen.shape[1]] = chosen
        # the same links the other way round; a node with too many keeps a diverse choice
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target != NONE], target[target != NONE]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        added = np.full((len(nodes), width), NONE, np.int64)
        place = np.arange(len(target)) - np.repeat(first, count)
        added[np.repeat(np.arange(len(nodes)), count), place] = source
        old = self.links[level][nodes]
        every = np.sort(np.concatenate([old, added], axis=1), axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = NONE
        limit = old.shape[1]
        ranked = -np.sort(-every, axis=1)
        fits = (ranked != NONE).sum(axis=1) <= limit
        self.links[level][nodes[fits]] = np.pad(ranked[fits][:, :limit], ((0, 0), (0, max(0, limit - ranked.shape[1]))), constant_values=NONE)
        crowded = np.flatnonzero(~fits)
        for at in range(0, len(crowded), TOGETHER):
            rows = crowded[at : at + TOGETHER]
            near = every[rows]
            sims = np.matmul(self.vectors[near], self.vectors[nodes[rows]][:, :, None])[:, :, 0]
            sims[near == NONE] = -np.inf
            self.links[level][nodes[rows]] = self._diverse(near, sims, limit)

    def _remember(self, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """What the searches for a batch found, as neighbours of both ends."""
        near_ids, near_sims = self.near
        keep = near_ids.shape[1]
        row, column = np.nonzero(sims > np.minimum(near_sims[:, -1][np.maximum(ids, 0)], 2))
        source, target, value = batch[row], ids[row, column], sims[row, column]
        best = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
        near_ids[batch, : best.shape[1]] = np.take_along_axis(ids, best, 1)
        near_sims[batch, : best.shape[1]] = np.take_along_axis(sims, best, 1)
        older = ~np.isin(target, batch)  # mates are in each other's lists already
        source, target, value = source[older], target[older], value[older]
        by = np.lexsort((-value, target))
        source, target, value = source[by], target[by], value[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        fits = place < keep
        row = np.repeat(np.arange(len(nodes)), count)[fits]
        new_ids, new_sims = np.full((len(nodes), keep), NONE, np.int32), np.full((len(nodes), keep), -np.inf, np.float32)
        new_ids[row, place[fits]], new_sims[row, place[fits]] = source[fits], value[fits]
        both = np.concatenate([near_sims[nodes], new_sims], axis=1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :keep]
        near_sims[nodes] = np.take_along_axis(both, best, 1)
        near_ids[nodes] = np.take_along_axis(np.concatenate([near_ids[nodes], new_ids], axis=1), best, 1)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
        """For each row the best candidates that are closer to the node than to one already chosen, then the best others."""
        width = min(ids.shape[1], 2 * limit)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        near = self.vectors[ids]
        between = np.matmul(near, near.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, bool)
        hidden = np.full(ids.shape, -np.inf, np.float32)  # the similarity to the nearest chosen one
        for c in range(width):
            kept[:, c] = (ids[:, c] != NONE) & (sims[:, c] > hidden[:, c]) & (kept.sum(axis=1) < limit)
            np.maximum(hidden, np.where(kept[:, c, None], between[:, c], -np.inf), out=hidden)
        rank = np.where(ids == NONE, 2 * width, np.where(kept, 0, width) + np.arange(width))
        best = np.argsort(rank, axis=1, kind="stable")[:, :limit]
        out = np.take_along_axis(ids, best, 1)
        return np.pad(out, ((0, 0), (0, limit - out.shape[1])), constant_values=NONE) if out.shape[1] < limit else out

    # -- storage --------------------------------------------------------------------------------------------------

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        upper = {f"links{i}": x.astype(np.int32) for i, x in enumerate(self.links)}
        np.savez(out, vectors=self.vectors.astype(np.float32), entry=np.int64(self.entry), **upper)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as x:
            links = [x[f"links{i}"] for i in range(sum(k.startswith("links") for k in x.files))]
            return Graph(x["vectors"], links, int(x["entry"]))
