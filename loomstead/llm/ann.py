"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard of bounded size.

Method. Rows fall into shards by hash of id; each shard holds about `shard_rows` rows, so that a graph fits one task at
any size of the table. A shard's graph grows in batches: greedy beam searches over the graph so far propose
neighbours of the new points, relaxed pruning (a candidate goes if a chosen neighbour is `alpha` times nearer to it)
keeps up to `degree` diverse edges, and reverse edges are added and pruned alike. All points of a batch advance
together in numpy. A query is searched with a beam in every shard; the shards' nearest are merged. Distances of the
results are computed anew in double precision on the original vectors.

Equal vectors of a shard are one point of the graph with a list of ids, so copies, however many, neither crowd
out the edges nor the beam; every row is indexed, and none is dropped.

A query goes to every shard. Shards of near vectors, of which a query sees only the nearest, would cost less, but on vectors
without clusters lose neighbours: see the README.

Edge cases: vectors that are null, empty, zero, or that hold null or non-finite components take no part, neither as queries nor as candidates;
vectors of several lengths are searched apart, each query among those of its own length; a query's own id is no neighbour of it; rows that repeat
an id are candidates each, and one query, whose vector is the least of theirs (by components in order); a null id takes no part;
ties go to the smaller id; fewer candidates than k: all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD_ROWS = 16_384
#: Of searches. At 96, queries from outside a full shard find only 86 % of its 10 nearest.
BEAM = 192


class Graph:
    """Directed graph over rows of `points` (float32, distinct)."""

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 1):
        self.x, self.degree, self.beam, self.alpha = points, degree, beam, np.float32(alpha)
        n = len(points)
        self.norm = np.einsum("ij,ij->i", points, points)
        self.edges = np.full((n, degree), -1, np.int32)
        mean = points.mean(0)
        self.entry = int(np.argmin(self.norm - 2 * points @ mean))
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        # The first points are few enough to be compared with each other.
        start = min(n, 256)
        self._link(order[:start], np.repeat(order[None, :start], start, 0))
        done = start
        while done < n:
            size = min(n - done, max(64, done // 4), 2048)
            new = order[done : done + size]
            found, _ = self.search(self.x[new], beam)
            self._link(new, found)
            done += size

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of rows of q to rows of ids; inf where an id is -1."""
        at = np.maximum(ids, 0)
        d = np.einsum("bd,bkd->bk", q, self.x[at], optimize=False)
        d = np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + self.norm[at] - 2 * d, 0)
        d[ids < 0] = np.inf
        return d

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the `beam` nearest that a greedy search finds, nearest first."""
        ids, ds = [], []
        for lo in range(0, len(queries), 512):
            a, b = self._search(queries[lo : lo + 512], beam)
            ids.append(a)
            ds.append(b)
        return np.concatenate(ids), np.concatenate(ds)

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m, n, width = len(q), len(self.x), 2
        ids = np.full((m, beam), -1, np.int32)
        ids[:, 0] = self.entry
        d = np.full((m, beam), np.inf, np.float32)
        d[:, 0] = self._distance(q, ids[:, :1])[:, 0]
        open_ = ids >= 0
        seen = np.zeros((m, (n + 7) // 8), np.uint8)
        rows = np.arange(m)
        seen[rows, self.entry >> 3] |= np.uint8(1 << (self.entry & 7))
        live = rows
        while len(live):
            score = np.where(open_[live], d[live], np.inf)
            best = np.argpartition(score, min(width, beam) - 1, 1)[:, :width] if beam > width else np.argsort(score, 1)[:, :width]
            ok = np.take_along_axis(open_[live], best, 1)
            keep = ok.any(1)
            live, best, ok = live[keep], best[keep], ok[keep]
            if not len(live):
                break
            open_[live[:, None], best] = False
            near = self.edges[np.where(ok, ids[live[:, None], best], 0)]
            near[~ok] = -1
            near = near.reshape(len(live), -1)
            at = np.maximum(near, 0)
            fresh = (near >= 0) & ((seen[live[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0)
            near = np.where(fresh, near, -1)
            # A node that two expanded ones share counts once.
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            np.bitwise_or.at(seen, (live[r], near[r, c] >> 3), (1 << (near[r, c] & 7)).astype(np.uint8))
            nd = self._distance(q[live], near).astype(np.float32)
            all_d, all_i = np.concatenate([d[live], nd], 1), np.concatenate([ids[live], near], 1)
            all_o = np.concatenate([open_[live], near >= 0], 1)
            pick = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            d[live], ids[live], open_[live] = (np.take_along_axis(x, pick, 1) for x in (all_d, all_i, all_o))
        order = np.argsort(d, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Edges of nodes become the diverse ones of candidates (-1: none)."""
        for lo in range(0, len(nodes), 256):
            a, c = nodes[lo : lo + 256], candidates[lo : lo + 256].copy()
            c[c == a[:, None]] = -1
            c.sort(1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            d = self._distance(self.x[a], c)
            order = np.argsort(d, 1, kind="stable")[:, : 4 * self.degree]
            c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
            xs, norms = self.x[np.maximum(c, 0)], self.norm[np.maximum(c, 0)]
            alive = c >= 0
            out = np.full((len(a), self.degree), -1, np.int32)
            rows = np.arange(len(a))
            for k in range(self.degree):
                p = alive.argmax(1)
                has = alive[rows, p]
                if not has.any():
                    break
                out[:, k] = np.where(has, c[rows, p], -1)
                to = norms + norms[rows, p][:, None] - 2 * np.einsum("bd,bkd->bk", xs[rows, p], xs)
                alive &= self.alpha * self.alpha * to > d
                alive[rows, p] = False
            self.edges[a] = out

    def _link(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        self._prune(nodes, np.concatenate([candidates, self.edges[nodes]], 1).astype(np.int32))
        src = np.repeat(nodes, self.degree)
        dst = self.edges[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(targets), 1024):
            t, f, n = targets[lo : lo + 1024], first[lo : lo + 1024], counts[lo : lo + 1024]
            back = np.full((len(t), int(n.max())), -1, np.int32)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            back[np.repeat(np.arange(len(t)), n), k] = src[np.repeat(f, n) + k]
            free = (self.edges[t] < 0).sum(1)
            easy = free >= n
            for row in np.flatnonzero(easy):
                mine = self.edges[t[row]]
                new = np.setdiff1d(back[row][: n[row]], mine)
                mine[np.flatnonzero(mine < 0)[: len(new)]] = new
            hard = ~easy
            if hard.any():
                self._prune(t[hard], np.concatenate([back[hard], self.edges[t[hard]]], 1))


def _matrix(col: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = col.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


class Shard:
    """Graph over the distinct vectors of one shard, with the ids of each, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, **options: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, inverse, counts = np.unique(vectors, axis=0, return_index=True, return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        self.ids = ids[np.argsort(inverse, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.vectors = vectors[first]
        self.graph = Graph(np.ascontiguousarray(self.vectors, np.float32), **options)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance) of the k nearest ids of each query, exact double distances."""
        found, _ = self.graph.search(np.ascontiguousarray(queries, np.float32), beam)
        rows, ids, scores = [], [], []
        for lo in range(0, len(found), 512):
            f = found[lo : lo + 512]
            d = np.sqrt(((queries[lo : lo + 512, None, :] - self.vectors[np.maximum(f, 0)]) ** 2).sum(2))
            d[f < 0] = np.inf
            for j in range(len(f)):
                points = f[j][f[j] >= 0]
                score = d[j][f[j] >= 0]
                n = np.minimum(self.first[points + 1] - self.first[points], k + 1)  # a point's first k ids and perhaps the query's own
                at = np.repeat(self.first[points] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                near, score = self.ids[at], np.repeat(score, n)
                ok = near != query_ids[lo + j]
                near, score = near[ok], score[ok]
                best = np.lexsort((near, score))[:k]
                rows.append(np.full(len(best), lo + j))
                ids.append(near[best])
                scores.append(score[best])
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)) if rows else (none, none, np.zeros(0))


def _run(k: int, beam: int, options: dict):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "vec_id": none, "score": pa.array([], pa.float64())})
        shard = Shard(rows["vec_id"].to_numpy(), _matrix(rows["v"], len(rows)), **options)
        q = queries["query_id"].to_numpy()
        row, ids, score = shard.nearest(q, _matrix(queries["v"], len(queries)), k, beam)
        return pa.table({"query_id": q[row], "vec_id": ids, "score": score})

    return run


def usable(df: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """(id, v: array<double>) of rows whose vector is whole, finite and not zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(common.column(df, id_name, "long").alias("id"), common.column(df, vector_name, "array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .filter(finite & F.exists(v, lambda x: x != 0))
    )


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, shard_rows: int = SHARD_ROWS, **options: float) -> DataFrame:
    """query_id, rank, vec_id, score. candidates and queries: (id, v) as `usable` gives them.

    A query id that repeats is one query (its least vector). Each query goes to every shard of its length.
    """
    n = candidates.count()
    shards = max(1, -(-n // shard_rows))
    rows = candidates.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long").alias("shard"), F.col("id").alias("vec_id"), "v")
    least = queries.groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = least.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "query_id", "v")
    found = rows.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInArrow(_run(k, beam, options), "query_id long, vec_id long, score double")
    # k rows from each shard for a query; the k best of them, without a window over more.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def nearest(embeddings: DataFrame, modulus: int = 100, k: int = 10, **options: float) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by modulus, among all other rows."""
    rows = usable(embeddings, "vec_id", "embedding")
    return search(rows, rows.filter(F.col("id") % modulus == 0), k, **options)
