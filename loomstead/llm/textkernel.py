"""Byte-level text kernels: words, lines and n-grams of many UTF-8 texts at once, in numpy.

A batch of texts is one byte array with offsets (an Arrow string column as it lies in memory). Words are runs of
bytes that are not separators; as all separators are ASCII, byte runs and character runs agree. A word's hash is
a polynomial over random 64-bit values of its bytes, read off prefix sums, so that no Python object is made per
word. Hashes are 64 bits wide: two of n different words share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
CHUNK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]

_powers: dict[str, np.ndarray] = {}


def settle() -> None:
    """At a task's end, as Python workers are reused: collection is on again, and freed memory goes back to the system."""
    gc.enable()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        seed = np.full(size, base, np.uint64)
        seed[0] = 1
        have = _powers[name] = np.cumprod(seed)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of the documents lo..hi of a batch: places in bytes, document (from lo) and hash of each."""

    lo: int
    hi: int
    data: np.ndarray
    base: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    @property
    def firsts(self) -> np.ndarray:
        """Index of each document's first word; one more entry at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `size` bytes; a longer document is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, separators: np.ndarray, lower: bool) -> Words:
    """Runs of bytes without a separator, within each document of lo..hi."""
    base = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
    part = data[offsets[lo] : offsets[hi]]
    n = len(part)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, part, base, none, none, none, np.zeros(0, np.uint64))
    sep = separators[part]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = sep[:-1]
    edge = base[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = sep[1:]
    after[edge - 1] = True
    word = ~sep
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    doc = np.searchsorted(base[1:], start, "right")
    return Words(lo, hi, part, base, start, end, doc, hash_ranges(part, start, end, lower))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of the bytes of each range, equal for equal bytes wherever they lie."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_VALUES if lower else _VALUES)[data] * _table("p", _BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _table("i", _INVERSE, n)[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = SPACE, size: int = CHUNK) -> Iterator[Words]:
    for lo, hi in chunks(offsets, size):
        yield runs(data, offsets, lo, hi, separators, lower)


def hash_word(word: bytes, lower: bool = False) -> int:
    """Hash of one word, as `words` gives it."""
    data = np.frombuffer(word, np.uint8)
    sums = ((_LOWER_VALUES if lower else _VALUES)[data] * _table("p", _BASE, len(data))).sum(dtype=np.uint64) if len(data) else _U(0)
    return int(mix(np.array([sums], np.uint64) + np.array([len(data) * 0xD6E8FEB86659FD93 % 2**64], np.uint64))[0])


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive hashes (windows may cross documents: see `inside`)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m]
    for k in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + m])
    return mix(out + _U(n)) if n > 1 else out


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """True for each window of n words that lies in one document."""
    m = len(doc) - n + 1
    return doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def per_doc_unique(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, ascending, as (hashes, offsets of n + 1)."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]).astype(np.int64)


def shingle_sets(w: Words, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document; one of fewer words has its whole sequence as one."""
    keep = inside(w.doc, n)
    h, doc = chain(w.hash, n)[keep], w.doc[: len(keep)][keep]
    counts, firsts = w.counts, w.firsts
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            at = firsts[short]
            part = w.hash[at]
            for j in range(1, k):
                part = mix(part * _U(0x9E3779B97F4A7C15) + w.hash[at + j])
            h, doc = np.concatenate([h, mix(part + _U(1000 + k))]), np.concatenate([doc, short])
    return per_doc_unique(doc, h, w.n)
