"""Token ids of many parts of texts at once: equal parts are looked up, and new ones learnt, once for each batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Entries that a table keeps, and ids of the longest of them: under 40 MB.
ENTRIES, LONGEST = 500_000, 24


class IdTable:
    """Ids by 64-bit key of a part: sorted keys with places in one array of ids. What the last batches used stays."""

    def __init__(self, entries: int = ENTRIES):
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def resolve(self, keys: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in their order, and the number of ids of each. learn(places) gives ids and numbers of ids of new parts, by one place of each."""
        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        u, one = ranked[new], order[new]
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        start, size, pool = np.empty(len(u), np.int64), np.empty(len(u), np.int64), self.ids
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            known = self.keys[at] == u
            start[known], size[known] = self.start[at[known]], self.size[at[known]]
        else:
            known = np.zeros(len(u), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            ids, n = learn(one[fresh])
            start[fresh], size[fresh] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids.astype(np.uint32)])
        n = size[group]
        ends = np.cumsum(n)
        out = pool[np.repeat(start[group] - (ends - n), n) + np.arange(int(ends[-1]))]
        if len(fresh):
            self._keep(u, start, size, pool, fresh)
        return out, n

    def _keep(self, u: np.ndarray, start: np.ndarray, size: np.ndarray, pool: np.ndarray, fresh: np.ndarray) -> None:
        if len(self.keys) + len(fresh) > self.entries or len(pool) > 8 * self.entries:
            some = np.flatnonzero(size <= LONGEST)[: self.entries]
            n = size[some]
            self.keys, self.size, self.start = u[some], n, np.cumsum(n) - n
            self.ids = pool[np.repeat(start[some] - self.start, n) + np.arange(int(n.sum()))]
            return
        some = fresh[size[fresh] <= LONGEST]
        keys = np.concatenate([self.keys, u[some]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.size = keys[order], np.concatenate([self.start, start[some]])[order], np.concatenate([self.size, size[some]])[order]
        self.ids = pool


class Probe:
    """Places in a sorted array of evenly spread 64-bit keys. The first bits of a key lead to the few keys that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys, np.full(1, np.iinfo(np.uint64).max, np.uint64)])
        bits = min(20, max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 3))
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(keys, edges).astype(np.int32)
        self.most = int(np.diff(self.first, append=len(keys)).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it isn't there."""
        flat = h.ravel()
        at = self.first[(flat >> self.shift).astype(np.int64)]
        out = np.where(self.keys[at] == flat, at, -1)
        if self.most > 1:
            # Only where the first of a group of keys is smaller can one of the next be meant.
            rest = np.flatnonzero(self.keys[at] < flat)
            want, at = flat[rest], at[rest]
            for k in range(1, self.most):
                here = np.minimum(at + k, len(self.keys) - 1)
                out[rest] = np.where(self.keys[here] == want, here, out[rest])
        return np.where(out < len(self.keys) - 1, out, -1).reshape(h.shape)
