"""Byte-pair merges of many words at once, in numpy."""

from __future__ import annotations

import numpy as np


def merge_rows(ids: np.ndarray, keys: np.ndarray, rank: np.ndarray, new: np.ndarray, stop: int = 1) -> np.ndarray:
    """Merges pairs in the rows of ids until none is known, or `stop` ids are left; gives the rows' lengths, ids being changed in place.

    A round merges each row's pair of least rank, the leftmost of equals. keys: sorted (left << 32 | right), with the rank
    and id of what they make. A negative id never merges.
    """
    rows, length = ids.shape
    n = np.full(rows, length)
    if length <= stop or not len(keys):
        return n
    none = np.iinfo(np.int64).max
    # Positions of known pairs are kept from round to round; only those beside a merge are looked up again.
    found = np.full((rows, length), none, np.int64)
    made = np.zeros((rows, length), np.int64)

    def probe(row: np.ndarray, col: np.ndarray) -> None:
        a, b = ids[row, col], ids[row, np.minimum(col + 1, length - 1)]
        key = np.where((a >= 0) & (b >= 0) & (col + 1 < n[row]), a << 32 | np.maximum(b, 0), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[at] == key
        found[row, col] = np.where(ok, rank[at], none)
        made[row, col] = new[at]

    r, c = np.indices((rows, length - 1))
    probe(r.ravel(), c.ravel())
    live = np.arange(rows)
    column = np.arange(length)
    while len(live):
        part = found[live]
        best = part.argmin(1)
        ok = part[np.arange(len(live)), best] != none
        live, best = live[ok], best[ok]
        if not len(live):
            break
        ids[live, best] = made[live, best]
        width = int(n[live].max())
        take = np.minimum(column[:width] + (column[:width] > best[:, None]), width - 1)
        for m in (ids, found, made):
            m[live, :width] = np.take_along_axis(m[live, :width], take, 1)
        n[live] -= 1
        found[live, n[live]] = none
        probe(live, best)
        left = best > 0
        probe(live[left], best[left] - 1)
        live = live[n[live] > stop]
    return n
