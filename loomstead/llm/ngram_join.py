"""N-gram Jaccard join: links between documents whose sets of word shingles are similar, exactly.

Method. A document's shingles fall into groups by hash; the counts by group are its point. The overlap of two
documents is at most the sum of the coordinate minima of their points, so R-trees over points (with the maxima of
each box) find the pairs that may be similar, and those are verified on whole sets.

An R-tree over all documents would compare every document with most boxes, so trees are built inside blocks
that every linked pair shares: with a threshold t, two linked sets share one of their first (1 - t) n + 1
shingles in any common order. The first that they share lies where the rest of both sets is still large enough for
the overlap, so entries of a block whose sizes or places rule that out are no pair. The order here puts frequent shingles last, so passages that many documents share
don't form large blocks; it is a matter of speed alone, the result holds for every order.

Steps: (1) one row per document: class (64-bit hash of its set), size, point; frequent shingles by task. (2) first shingles,
packed by range of hash; shingles of two or more classes give blocks, equal blocks are merged. (3) families: classes that
pairs connect which share a block and whose points allow a link. A pair is tested only while its classes are in different
families, so a block of near copies costs about a test for each class. (4) in each family, large ones in pairs of chunks, an R-tree
over the points proposes pairs, which are verified on the whole sets of the texts; only counts and edges leave the task.
(5) counts are summed with the sizes of classes; components of edges give the groups. Neither copies nor candidates are ever stored as pairs.

Edge cases: null or blank text has an empty set, no link and its own id as component; rows that repeat a doc_id
count as documents of their own; a null doc_id is counted but is nobody's component_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

_U = np.uint64
#: Frequent shingles that are put last: a fixed number, 6 MB, whatever the input.
ORDERED = 1 << 19
LOCAL_DF = 2
LEVELS = (4, 12)
LEAF = 16
#: Classes of a block beyond which it is cut into pairs of chunks; rows of blocks in a task of step 3.
BLOCK_CLASSES, GROUP_ROWS = 8192, 150_000
#: Classes and shingles of a family beyond which it is verified in pairs of chunks; shingles and classes in a task of step 4, about.
CHUNK_DOCS, CHUNK_SHINGLES, GROUP_SHINGLES, GROUP_CLASSES = 1024, 600_000, 750_000, 1_000
#: Cells of points, and items of sets, that are compared at once.
CELLS, ITEMS = 1 << 21, 500_000
#: Bits of the map of texts that verification needs: 8 MB, whatever the input; a set bit too many costs time alone.
MAP_BITS = 26

#: Sizes of sets from here on are one in step 2; blocks of more classes than FEW aren't divided by size and place.
LARGE, FEW = 65_535, 16

#: Shingles that are gathered in a task before they are counted or packed.
TOGETHER = 700_000
#: First shingles in a group of step 2, about: 100 bytes each while blocks are made.
BUCKET_ENTRIES = 300_000

_DOCS = "kind int, doc_id long, text_hash long, cls long, n long, level int, excess int, point binary, shingle long, df long"


def _levels(n: np.ndarray) -> np.ndarray:
    """log2 of the number of groups: 2 to 4 shingles in each, within LEVELS."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 4)), *LEVELS).astype(np.int64)


def _points(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels, counts above 15, and points of 4-bit counts: bytes and offsets."""
    n = np.diff(offsets)
    level = _levels(n)
    at = np.concatenate([[0], np.cumsum(1 << level)])
    doc = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(at[:-1][doc] + (h >> (64 - level[doc]).astype(np.uint64)).astype(np.int64), minlength=at[-1])
    over = np.concatenate([[0], np.cumsum(np.maximum(counts - 15, 0))])
    counts = np.minimum(counts, 15).astype(np.uint8)
    return level, over[at[1:]] - over[at[:-1]], counts[0::2] | (counts[1::2] << 4), at // 2


def classes_of(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[_U(0)], np.cumsum(K.mix(h ^ _U(0xA24BAED4963EE407)), dtype=np.uint64)])
    return K.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.column_bytes(batch.column(batch.schema.get_field_index(column)))
    for w in K.words(data, offsets, lower=True):
        yield w.lo, w.hi, *K.shingle_sets(w, width)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            seen = []
            for lo, hi, h, offsets in _sets(batch, "text", width):
                level, excess, point, at = _points(h, offsets)
                m = hi - lo
                part = batch.slice(lo, m)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), part.column(0), part.column(1), pa.array(classes_of(h, offsets)), pa.array(np.diff(offsets)), pa.array(level.astype(np.int32)), pa.array(excess.astype(np.int32)), _binary(point, at), none, none],
                    names=[x.split()[0] for x in _DOCS.split(", ")],
                )
                seen.append(h)
                if sum(map(len, seen)) > TOGETHER:
                    yield frequent(seen)
                    seen = []
            if seen:
                yield frequent(seen)
        K.settle()

    def frequent(seen: list[np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(seen), return_counts=True)
        u, c = u[c >= LOCAL_DF], c[c >= LOCAL_DF]
        m = len(u)
        no = pa.nulls
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int32)), *[no(m, pa.int64())] * 4, no(m, pa.int32()), no(m, pa.int32()), no(m, pa.binary()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))],
            names=[x.split()[0] for x in _DOCS.split(", ")],
        )

    return run


def _prefixes(width: int, num: int, den: int, buckets: int, ordered: tuple[np.ndarray, np.ndarray]):
    """Packs the first shingles of documents by bucket: classes, sizes, numbers of shingles, and for each shingle 24 bits of its hash below its place.

    Two shingles of a bucket that share the 24 bits make a block too many at worst.
    """
    last, rank = ordered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            held, rows = [], 0
            for _, _, h, offsets in _sets(batch, "text", width):
                n = np.diff(offsets)
                doc = np.repeat(np.arange(len(n)), n)
                if len(last):
                    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
                    r = np.where(last[at] == h, rank[at], 0)
                    h = h[np.argsort(doc * (len(last) + 2) + r, kind="stable")]
                first = np.where(n > 0, n + (-num * n // den) + 1, 0)
                place = np.arange(len(h)) - offsets[doc]
                keep = place < first[doc]
                share = np.minimum(place[keep] * 255 * den // (n[doc[keep]] * (den - num)), 255) if num < den else np.zeros(keep.sum(), np.int64)
                value = (h[keep] & _U(0xFFFFFF)).astype(np.uint32) | share.astype(np.uint32) << np.uint32(24)
                bucket = ((h[keep] >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int32)
                held.append((bucket, np.repeat(classes_of(h, offsets), first), np.repeat(np.minimum(n, LARGE).astype(np.uint16), first), value))  # classes are sums, which don't depend on the order
                rows += len(value)
                if rows > TOGETHER:
                    yield from packed(held)
                    held, rows = [], 0
            if rows:
                yield from packed(held)
        K.settle()

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, c, n, v = (np.concatenate([x[k] for x in held]) for k in range(4))
        order = np.lexsort((c, bucket))
        bucket, c, n, v = bucket[order], c[order], n[order], v[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.concatenate([starts, [len(c)]])).astype(np.uint32)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
        ids, blobs = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            a, b = np.searchsorted(starts, [lo, hi])
            ids.append(int(bucket[lo]))
            blobs.append((c[starts[a:b]].tobytes(), n[starts[a:b]].tobytes(), lengths[a:b].tobytes(), v[lo:hi].tobytes()))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(x, pa.binary()) for x in zip(*blobs)]], names=["bucket", "classes", "sizes", "lengths", "hashes"])

    return run


def _blocks(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Shingles of two or more classes, as far as sizes and places allow a link; equal sets of classes once."""
        np.seterr(over="ignore")
        cls, sizes, lengths, v = (np.frombuffer(b"".join(table[x].to_pylist()), kind) for x, kind in (("classes", np.int64), ("sizes", np.uint16), ("lengths", np.uint32), ("hashes", np.uint32)))
        c, n = np.repeat(cls, lengths), np.repeat(sizes, lengths).astype(np.int64)
        h = v & np.uint32(0xFFFFFF)
        order = np.lexsort((c, h))
        h, c, n, v = h[order], c[order], n[order], v[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n = h[new], c[new], n[new]
        left = n - (v[new] >> np.uint32(24)).astype(np.int64) * n * (den - num) // (255 * den)  # of the set from here on, at most
        at = np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1, append=-2))
        m = np.diff(at)
        # Labels: the first entry of what is connected; larger blocks stay whole.
        label = np.where(np.repeat(m, m) > FEW, np.repeat(at[:-1], m), np.arange(len(h)))
        some = np.flatnonzero((m >= 2) & (m <= FEW))
        total, lo, pairs = np.cumsum(m[some] * (m[some] - 1) // 2), 0, []
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 1_000_000, "right")))
            i, j = _pairs_in(at[some[lo:hi]], m[some[lo:hi]])
            fits = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & ((num + den) * np.minimum(left[i], left[j]) >= num * (n[i] + n[j]))
            fits |= (n[i] == LARGE) | (n[j] == LARGE)  # sizes that aren't known
            pairs.append((i[fits], j[fits]))
            lo = hi
        if pairs:
            x, y = stars(np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs]), len(h))
            label[x] = y
        order = np.argsort(label, kind="stable")
        c, at = c[order], np.flatnonzero(np.diff(label[order], prepend=-1, append=-2))
        m = np.diff(at)
        sums = np.concatenate([[_U(0)], np.cumsum(K.mix(c.view(np.uint64)), dtype=np.uint64)])
        key = K.mix(sums[at[1:]] - sums[at[:-1]] + m.astype(np.uint64)) if len(m) else np.zeros(0, np.uint64)
        big = np.flatnonzero(m >= 2)
        _, one = np.unique(key[big], return_index=True)
        pick = big[one]
        size = m[pick]
        where = np.repeat(at[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        members = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.array(c[where])).cast(pa.list_(pa.int64()))
        # Members ascend, so a block's first is its smallest class: blocks of one family of copies mostly share it.
        K.settle()
        return pa.table({"block": pa.array(key[pick].view(np.int64)), "m": pa.array(size.astype(np.int64)), "least": pa.array(c[at[pick]]), "members": members})

    return run


def stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the pairs a, b over 0..n connect."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b):
            np.minimum.at(label, x, low)
            np.minimum.at(label, before[x], low)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def fold(matrix: np.ndarray, level: int) -> np.ndarray:
    """Counts of a coarser level: sums of neighbouring groups."""
    groups = 1 << level
    return matrix if matrix.shape[1] == groups else matrix.reshape(len(matrix), groups, -1).sum(2, dtype=np.uint8 if matrix.shape[1] // groups <= 16 else np.uint16)


def _may_link(bound: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return (num + den) * bound >= num * (a + b)


class RTree:
    """Packed R-tree over count vectors; a box keeps coordinate maxima, its smallest size and largest excess."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, excess: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        spread = np.argsort(-points.astype(np.float32).var(0))[:2]
        order = np.lexsort((points[:, spread[0]], sizes))
        for lo in range(0, len(order), LEAF * LEAF):  # tiles by size, then by the coordinate that spreads most
            part = order[lo : lo + LEAF * LEAF]
            order[lo : lo + LEAF * LEAF] = part[np.lexsort((points[part, spread[-1]], points[part, spread[0]]))]
        self.order = order
        self.floors = [(points[order], sizes[order], sizes[order], excess[order])]
        while len(self.floors[-1][0]) > 1:
            p, least, most, e = self.floors[-1]
            at = np.arange(0, len(p), LEAF)
            self.floors.append((np.maximum.reduceat(p, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(e, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose bounds allow a link."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for depth in range(len(self.floors) - 1, -1, -1):
            p, least, most, e = self.floors[depth]
            keep = []
            step = min(8192, max(1, CELLS // p.shape[1]))
            for lo in range(0, len(q), step):
                a, b = q[lo : lo + step], node[lo : lo + step]
                bound = np.minimum(points[a], p[b]).sum(1, dtype=np.int64) + np.minimum(excess[a], e[b])
                keep.append(_may_link(bound, sizes[a], least[b], self.num, self.den) & (self.den * sizes[a] >= self.num * least[b]) & (self.den * most[b] >= self.num * sizes[a]))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            q, node = q[keep], node[keep]
            if depth:
                below = len(self.floors[depth - 1][0])
                q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node]


def _pairs_in(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside runs of rows, as row numbers."""
    first = np.repeat(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), 1)
    rest = np.repeat(sizes, sizes) - 1 - first
    row = np.repeat(starts, sizes) + first
    i = np.repeat(row, rest)
    j = i + 1 + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
    return i, j


class Points:
    """Count vectors of classes by level, unpacked, and those of a level folded to the one below.

    Counts end at 15, and what is above counts as excess: an overlap is at most the sum of minima and the lesser excess.
    """

    def __init__(self, level: np.ndarray, packed: list[bytes], excess: np.ndarray):
        self.level, self.place, self.of = level, np.zeros(len(level), np.int64), {}
        for lv in np.unique(level).tolist():
            at = np.flatnonzero(level == lv)
            self.place[at] = np.arange(len(at))
            raw = np.frombuffer(b"".join(packed[x] for x in at), np.uint8).reshape(len(at), -1)
            full = np.empty((len(at), raw.shape[1] * 2), np.uint8)
            full[:, 0::2], full[:, 1::2] = raw & 15, raw >> 4
            self.of[lv, lv] = full, excess[at]
            if lv > 0:
                down = fold(full, lv - 1)
                self.of[lv, lv - 1] = np.minimum(down, 15).astype(np.uint8), excess[at] + np.maximum(down.astype(np.int64) - 15, 0).sum(1)

    def rows(self, which: np.ndarray, own: int, lv: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of classes of level `own` on level lv, and excess."""
        counts, excess = self.of[own, lv]
        return counts[self.place[which]], excess[self.place[which]]


def _bounds(points: Points, n: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """True for pairs whose sizes and points allow a link."""
    out = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (np.abs(points.level[a] - points.level[b]) <= 1)
    low, high = np.minimum(points.level[a], points.level[b]), np.maximum(points.level[a], points.level[b])
    for lv in np.unique(low[out]).tolist():
        for up in (lv, lv + 1):
            every = np.flatnonzero(out & (low == lv) & (high == up))
            step = max(1, CELLS >> lv)
            for lo in range(0, len(every), step):
                at = every[lo : lo + step]
                x, y = np.where(points.level[a[at]] == lv, a[at], b[at]), np.where(points.level[a[at]] == lv, b[at], a[at])
                (p, e), (q, f) = points.rows(x, lv, lv), points.rows(y, up, lv)
                out[at] = _may_link(np.minimum(p, q).sum(1, dtype=np.int64) + np.minimum(e, f), n[x], n[y], num, den)
    return out


def tree_pairs(points: Points, n: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left, of right) that R-trees over the points of right find; of pairs of one set with itself, both orders come."""
    some_a, some_b = [], []
    for lv in np.unique(points.level[right]).tolist():
        inner = right[points.level[right] == lv]
        trees: dict[int, RTree] = {}
        for up in (lv - 1, lv, lv + 1):  # where levels differ by one, the finer side is folded
            outer = left[points.level[left] == up]
            if len(outer):
                at = min(lv, up)
                if at not in trees:
                    p, e = points.rows(inner, lv, at)
                    trees[at] = RTree(p, n[inner], e, num, den)
                p, e = points.rows(outer, up, at)
                a, b = trees[at].search(p, n[outer], e)
                some_a.append(outer[a])
                some_b.append(inner[b])
    none = np.zeros(0, np.int64)
    return (np.concatenate(some_a), np.concatenate(some_b)) if some_a else (none, none)


class Families:
    """Labels of classes: the smallest class that each is connected with so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            nodes, at = np.unique(self.label[np.concatenate([a, b])], return_inverse=True)
            x, y = stars(at[: len(a)], at[len(a) :], len(nodes))
            if len(x):
                to = np.arange(len(self.label))
                to[nodes[x]] = nodes[y]
                self.label = to[self.label]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.label[a] != self.label[b]


def _connect(families: Families, member: np.ndarray, points: Points, n: np.ndarray, num: int, den: int) -> None:
    """Joins what pairs of a large block connect."""
    for k in (0, len(member) // 2, -1):  # a few members are compared with all: near copies end up in one family at once
        other = member[families.apart(member, np.full(len(member), member[k]))]
        if not len(other):
            return
        first = np.full(len(other), member[k])
        ok = _bounds(points, n, first, other, num, den)
        families.join(first[ok], other[ok])
    # Each pair across families has an end outside the largest one.
    names, counts = np.unique(families.label[member], return_counts=True)
    rest = member[families.label[member] != names[counts.argmax()]]
    for lo in range(0, len(rest), 256):
        some = rest[lo : lo + 256]
        a, b = tree_pairs(points, n, some, member, num, den)
        ok = families.apart(a, b)
        families.join(a[ok], b[ok])
        if (families.label[member] == families.label[member[0]]).all():
            return


def _families(num: int, den: int):
    def run(key: tuple, lists: pa.Table, table: pa.Table) -> pa.Table:
        """Edges (class, smallest class of its family) of one group of blocks."""
        pick = np.argsort(table["cls"].to_numpy(), kind="stable")
        u = table["cls"].to_numpy()[pick]
        n, level, excess = (table[c].to_numpy()[pick].astype(np.int64) for c in ("n", "level", "excess"))
        sizes = pc.list_value_length(lists["members"]).to_numpy().astype(np.int64)
        row = np.searchsorted(u, pc.list_flatten(lists["members"]).to_numpy())
        edges = np.concatenate([[0], np.cumsum(sizes)])
        points = Points(level, table["point"].take(pa.array(pick)).to_pylist(), excess)
        families = Families(len(u))
        small = np.flatnonzero((sizes >= 2) & (sizes <= 64))
        small = small[np.argsort(-sizes[small], kind="stable")]
        total, lo = np.cumsum(sizes[small] * (sizes[small] - 1) // 2), 0
        for s in np.flatnonzero(sizes > 64)[np.argsort(-sizes[sizes > 64], kind="stable")].tolist():
            _connect(families, row[edges[s] : edges[s + 1]], points, n, num, den)
        while lo < len(small):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 200_000, "right")))
            i, j = _pairs_in(edges[small[lo:hi]], sizes[small[lo:hi]])
            a, b = row[i], row[j]
            ok = families.apart(a, b)
            code = np.unique(np.minimum(a[ok], b[ok]) * len(u) + np.maximum(a[ok], b[ok]))
            a, b = code // len(u), code % len(u)
            ok = _bounds(points, n, a, b, num, den)
            families.join(a[ok], b[ok])
            lo = hi
        at = np.flatnonzero(families.label != np.arange(len(u)))
        return pa.table({"a": pa.array(u[at]), "b": pa.array(u[families.label[at]])})

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=batch.schema.names)


def _needed(bits: np.ndarray):
    """Rows whose text is on the map; of rows equal in doc_id and text, one of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text_hash").to_numpy()
            at = text & ((1 << MAP_BITS) - 1)
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()
            row = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row = row[np.lexsort((row, ids[row], text[row]))]
            new = np.ones(len(row), bool)
            new[1:] = (text[row][1:] != text[row][:-1]) | (ids[row][1:] != ids[row][:-1])
            yield batch.take(pa.array(np.sort(row[new])))
        K.settle()

    return run


def _bits(table: pa.Table) -> pa.Table:
    """8 KB of the map."""
    bit = table["bit"].to_numpy()
    out = np.zeros(1 << 16, bool)
    out[bit & 0xFFFF] = True
    return pa.table({"part": pa.array([int(bit[0]) >> 16], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})


def overlaps(h: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x and y (sets: h[at[k] : at[k + 1]], distinct)."""
    n = np.diff(at)
    u, local = np.unique(h, return_inverse=True)
    shared = np.bincount(local, minlength=len(u)) > 1
    rows, row_x = np.unique(x, return_inverse=True)
    columns, row_y = np.unique(y, return_inverse=True)
    out = np.zeros(len(x), np.int64)
    wide = np.flatnonzero(shared)
    # Products of 0/1 matrices where most pairs are asked for, 2 flops a cell; else the smaller set is looked up in the larger.
    if len(rows) * len(columns) * len(wide) < 300 * np.minimum(n[x], n[y]).sum():
        doc = np.repeat(np.arange(len(n)), n)
        keep = shared[local]
        doc, item = doc[keep], (np.cumsum(shared) - 1)[local[keep]]
        order = np.argsort(item, kind="stable")
        doc, item = doc[order], item[order]
        in_x, in_y = np.full(len(n), -1), np.full(len(n), -1)
        in_x[rows], in_y[columns] = np.arange(len(rows)), np.arange(len(columns))
        product = np.zeros((len(rows), len(columns)), np.float32)
        for lo in range(0, len(wide), 4096):
            s = slice(*np.searchsorted(item, [lo, lo + 4096]))
            left, right = np.zeros((len(rows), 4096), np.float32), np.zeros((len(columns), 4096), np.float32)
            ok = in_x[doc[s]] >= 0
            left[in_x[doc[s]][ok], item[s][ok] - lo] = 1
            ok = in_y[doc[s]] >= 0
            right[in_y[doc[s]][ok], item[s][ok] - lo] = 1
            product += left @ right.T
        return product[row_x, row_y].astype(np.int64)
    x, y = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
    vocabulary = len(u)
    held = np.sort(np.repeat(np.arange(len(n)), n) * vocabulary + local)
    lo, size = 0, np.cumsum(n[x])
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + ITEMS, "right")))
        m = n[x[lo:hi]]
        item = np.repeat(at[x[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        probe = np.repeat(y[lo:hi], m) * vocabulary + local[item]
        hit = held[np.minimum(np.searchsorted(held, probe), len(held) - 1)] == probe
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), m), hit, minlength=hi - lo).astype(np.int64)
        lo = hi
    return out


def _verify(width: int, num: int, den: int, keep_pairs: bool):
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        """Of one group: the numbers of documents that pairs similar enough give each class (kind 2: class, number), edges that connect as they do (kind 1), and if asked for the pairs (kind 0)."""
        np.seterr(over="ignore")
        want, side = texts["cls"].to_numpy(), texts["half"].to_numpy()
        hs, keys = [], []
        for batch in texts.select(["text"]).to_batches():
            for _, _, h, offsets in _sets(batch, "text", width):
                hs.append(h)
                keys.append(np.diff(offsets))
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        n = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        del hs, keys
        # One text of each class; a text whose hash is that of another one isn't of the class.
        right = np.flatnonzero(classes_of(h, at) == want)
        ids, one = np.unique(want[right], return_index=True)
        one = right[one]
        if len(one) < len(np.unique(want)):
            raise ValueError("a class has no text")
        m = n[one]
        h = h[np.repeat(at[one] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        at = np.concatenate([[0], np.cumsum(m)]).astype(np.int64)
        side, copies = side[one], texts["copies"].to_numpy()[one]
        level, excess, packed, edge = _points(h, at)
        points = Points(level, [packed[edge[k] : edge[k + 1]].tobytes() for k in range(len(level))], excess)
        every = np.arange(len(ids))
        left, other = (every[side <= 0], every[side != 0]) if (side >= 0).any() else (every, every)
        a, b = tree_pairs(points, m, left, other, num, den)
        ok = (a < b) if len(left) == len(every) else a != b
        a, b = a[ok], b[ok]
        links = overlaps(h, at, a, b) if len(a) else np.zeros(0, np.int64)
        good = den * links >= num * (m[a] + m[b] - links)
        a, b = a[good], b[good]
        others = np.bincount(a, copies[b], minlength=len(ids)) + np.bincount(b, copies[a], minlength=len(ids)) if len(a) else np.zeros(len(ids))
        some = np.flatnonzero(others)
        p, q = stars(a, b, len(ids))
        x, y = (a, b) if keep_pairs else (a[:0], b[:0])
        del h, points, packed
        K.settle()
        return pa.table({
            "kind": pa.array(np.repeat([0, 1, 2], [len(x), len(p), len(some)]).astype(np.int32)),
            "a": pa.array(ids[np.concatenate([x, p, some]).astype(np.int64)]), "b": pa.array(np.concatenate([ids[y], ids[q], others[some].astype(np.int64)])),
        })

    return run


def _chunks(held: DataFrame) -> DataFrame:
    """(label, c): the chunks of a family (label, n: one row a class), few enough classes and shingles in each."""
    return held.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.least(F.count("*"), F.ceil(F.sum("n") / CHUNK_SHINGLES))).alias("c"))


def jaccard_links(docs: DataFrame, num: int = 70, den: int = 100, width: int = 3, keep_pairs: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links), written tables.

    members: doc_id, cls, n; one row per document. classes: cls, copies, least (smallest doc_id). links: kind, a, b;
    kind 0: each linked pair of different classes once, if keep_pairs; kind 1: edges that connect the same classes; kind 2: class and the
    number of documents of classes linked with it, in parts to be summed.
    """
    base = common.pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    described = common.save(base.mapInArrow(_describe(width), _DOCS), "jaccard-documents")
    members = described.filter("kind = 0").select("doc_id", "text_hash", "cls", "n", "level", "excess", "point")
    counted = described.filter("kind = 1").groupBy("shingle").agg(F.sum("df").alias("df"))
    # The least df of which there are at most ORDERED shingles: from a histogram in powers of 1.1, at most a few hundred rows.
    step = F.floor(F.log(F.col("df").cast("double")) / F.log(F.lit(1.1)))
    least, held = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("df").alias("df")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > ORDERED:
            break
        least = r["df"]
    blobs = counted.filter(F.col("df") >= least).mapInArrow(_pack, "shingle binary, df binary").collect() if least is not None else []
    hashes = np.frombuffer(b"".join(r["shingle"] for r in blobs), np.int64).view(np.uint64)
    df = np.frombuffer(b"".join(r["df"] for r in blobs), np.int64)
    rank = np.empty(len(df), np.uint32)
    rank[np.lexsort((hashes, df))] = np.arange(1, len(df) + 1)
    order = np.argsort(hashes)
    classes = common.save(
        members.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first(F.struct("n", "level", "excess", "point")).alias("p")).select("cls", "one.*", "least", "copies", "p.*"),
        "jaccard-classes",
    )
    entries = classes.agg(F.sum(F.floor(F.col("n") * (den - num) / den) + 1)).first()[0] or 0
    buckets = max(1, -(-int(entries) // BUCKET_ENTRIES))
    blocks = (
        base.mapInArrow(_prefixes(width, num, den, buckets, (hashes[order], rank[order])), "bucket int, classes binary, sizes binary, lengths binary, hashes binary")
        .groupBy("bucket")
        .applyInArrow(_blocks(num, den), "block long, m long, least long, members array<long>")
    )
    blocks = common.save(blocks.dropDuplicates(["block"]), "jaccard-blocks")
    common.release(base.sparkSession)
    # Blocks of one family meet in one group, which needs each class's point once; a family beyond a group's size is spread.
    rows = int(blocks.agg(F.sum("m")).first()[0] or 0)
    groups = max(1, -(-rows // GROUP_ROWS))
    family = blocks.groupBy("least").agg(F.sum("m").alias("w"))
    spread = F.when(F.col("w") > GROUP_ROWS, F.xxhash64("least", F.pmod("block", F.ceil(F.col("w") / GROUP_ROWS)))).otherwise(F.xxhash64("least"))
    placed = blocks.join(family, "least").withColumn("g", F.pmod(spread, F.lit(groups))).withColumn("c", F.ceil(F.col("m") / BLOCK_CLASSES))
    small = placed.filter("c = 1").select("g", "members")
    # A block of more classes is cut into chunks by hash, and each pair of chunks is a list: across chunks, or (i = j) inside one.
    cut = placed.filter("c > 1").select("block", "c", F.explode("members").alias("x")).withColumn("i", F.pmod(F.xxhash64("x"), "c")).groupBy("block", "c", "i").agg(F.collect_list("x").alias("xs"))
    other = cut.select("block", F.col("i").alias("j"), F.col("xs").alias("ys"))
    large = cut.join(other, "block").filter("i <= j").select(F.pmod(F.xxhash64("block", "i", "j"), F.lit(groups)).alias("g"), F.when(F.col("i") == F.col("j"), F.col("xs")).otherwise(F.concat("xs", "ys")).alias("members"))
    lists = common.save(small.unionByName(large), "jaccard-lists")
    wanted = lists.select("g", F.explode("members").alias("cls")).distinct().join(classes.select("cls", "n", "level", "excess", "point"), "cls").withColumnRenamed("g", "at")
    edges = lists.groupBy("g").cogroup(wanted.groupBy("at")).applyInArrow(_families(num, den), "a long, b long")
    parts = common.save(common.components(edges, "jaccard-parts"), "jaccard-parts")
    common.forget(blocks, lists)
    common.release(base.sparkSession)
    held = parts.withColumnRenamed("node", "cls").join(classes.select("cls", "doc_id", "text_hash", "copies", "n"), "cls")
    sums = held.agg(F.count("*"), F.sum("n")).first()
    # Small families share groups, as a group costs a call; large ones are split into pairs of chunks.
    few = max(1, -(-int(sums[0]) // GROUP_CLASSES), -(-int(sums[1] or 0) // GROUP_SHINGLES))
    held = held.join(_chunks(held), "label").withColumn("i", F.pmod(F.xxhash64("cls"), "c")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    whole = F.pmod(F.xxhash64("label"), F.lit(few))
    needed = common.save(
        held.select(
            F.when(F.col("c") == 1, whole).otherwise(F.xxhash64("label", F.least("i", "j"), F.greatest("i", "j"))).alias("part"),
            F.when(F.col("i") == F.col("j"), -1).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("half"), "cls", "doc_id", "text_hash", "copies",
        ),
        "jaccard-needed",
    )
    bit = needed.select(F.col("text_hash").bitwiseAND((1 << MAP_BITS) - 1).alias("bit")).distinct()
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in bit.groupBy(F.shiftright("bit", 16)).applyInArrow(_bits, "part long, bits binary").collect():
        bits[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    t = base.mapInArrow(_needed(bits), base.schema).alias("t")
    n = needed.alias("n")
    texts = t.join(n, (F.col("t.text_hash") == F.col("n.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("n.doc_id"))).select("n.part", "n.half", "n.cls", "n.copies", "t.text")
    links = common.save(texts.groupBy("part").applyInArrow(_verify(width, num, den, keep_pairs), "kind int, a long, b long"), "jaccard-links")
    common.forget(needed, parts)
    common.release(base.sparkSession)
    return members.select("doc_id", "cls", "n"), classes.select("cls", "copies", "least"), links


def jaccard_join(docs: DataFrame, num: int = 70, den: int = 100, width: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id, class_id.

    n_similar counts the other documents whose sets have Jaccard similarity num/den or more, copies included;
    component_id is the smallest doc_id that links reach.
    """
    members, classes, links = jaccard_links(docs, num, den, width, keep_pairs=False)
    linked = links.filter("kind = 2").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("others"))
    parts = common.components(links.filter("kind = 1").select("a", "b"), "jaccard-components")
    roots = parts.withColumnRenamed("node", "cls").join(classes, "cls")
    named = roots.join(roots.groupBy("label").agg(F.min("least").alias("root")), "label").select("cls", "root")
    known = classes.join(linked, "cls", "left").join(named, "cls", "left").select(
        "cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("root", "least").alias("component_id")
    )
    some = members.filter("n > 0").join(known, "cls").select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id", F.col("cls").alias("class_id"))
    none = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return some.unionByName(none)
