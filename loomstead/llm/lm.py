"""Language-model scores of documents by stupid backoff, from n-gram counts over the whole corpus.

Method. n-grams of words are hashed and counted in tables partitioned by hash; the counts of those a document holds are
joined back, and per document the log scores of its words are summed. A word's score is count(n-gram) / count(context) where the n-gram was
counted at least `min_count` times, else `backoff` times its score with a context one word shorter, down to count / total.

Both directions of that join are packed: documents fall into blocks by a hash of their text; a block sends each range of
hashes its distinct n-grams with their counts in it (9 bytes or so each, sums made before the shuffle), and gets
back their counts in the corpus in the same order, a byte each but for high ones. What is sent grows with the corpus; a range's table is one task of bounded size; no n-gram, block or document is in more than one group, and
a frequent n-gram is one row per block at most.

Edge cases: null or blank text has no words, score 0 and a null mean; a text shorter than the order uses shorter contexts; n-grams don't cross documents; repeated
rows count and are scored each; null doc_id stays null; other columns are ignored. Words are lower-cased (A-Z) runs of non-blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

_U = np.uint64
BLOCK_BYTES, RANGE_ROWS = 7_000_000, 2_000_000


def _grams(data: np.ndarray, offsets: np.ndarray, order: int):
    """Per chunk of documents: words, and for n = 1..order the hash of the n-gram that ends at each word (0 where there is none)."""
    for w in K.words(data, offsets, lower=True):
        ends = [np.where(w.hash == 0, _U(1), w.hash)]
        for n in range(2, order + 1):
            h = np.zeros(len(w.hash), np.uint64)
            keep = K.inside(w.doc, n)
            if len(keep):
                h[n - 1 :] = np.where(keep, np.maximum(K.chain(w.hash, n) + _U(n), _U(1)), 0)
            ends.append(h)
        yield w, ends


def count_words(docs: DataFrame) -> tuple[int, int]:
    """Words and bytes of all texts."""

    def run(batches):
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            word = ~K.SPACE[data]
            starts = word.copy()
            starts[1:] &= ~word[:-1]
            at = np.unique(offsets[1:-1])
            at = at[(at > 0) & (at < len(data))]
            extra = int((word[at] & word[at - 1]).sum()) if len(at) else 0
            yield pa.RecordBatch.from_arrays([pa.array([int(starts.sum()) + extra]), pa.array([len(data)])], names=["n", "size"])

    r = docs.select("text").mapInArrow(run, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    return int(r[0] or 0), int(r[1] or 0)


def _counted(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    np.seterr(over="ignore")
    us, cs = [], []
    data, offsets = K.column_bytes(table["text"])
    for _, ends in _grams(data, offsets, order):
        h = np.concatenate(ends)
        u, c = np.unique(h[h != 0], return_counts=True)
        us.append(u)
        cs.append(c)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = np.concatenate(us), np.concatenate(cs)
    order_ = np.argsort(h, kind="stable")
    h, c = h[order_], c[order_]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return (h[at], np.add.reduceat(c, at)) if len(h) else (h, c)


def _send(ranges: int, order: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, c = _counted(table, order)
        cut = ((h >> _U(40)) * _U(ranges) >> _U(24)).astype(np.int64)
        edges = np.concatenate([np.flatnonzero(np.diff(cut, prepend=-1)), [len(cut)]])
        rows = [(int(cut[lo]), h[lo:hi].tobytes(), np.minimum(c[lo:hi], 255).astype(np.uint8).tobytes(), c[lo:hi][c[lo:hi] >= 255].astype(np.int64).tobytes()) for lo, hi in zip(edges[:-1], edges[1:])]
        rows = rows or [(0, b"", b"", b"")]
        return pa.table({
            "range": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "grams": pa.array([r[1] for r in rows], pa.binary()), "few": pa.array([r[2] for r in rows], pa.binary()), "many": pa.array([r[3] for r in rows], pa.binary()),
        })

    return run


def _unpack(few: bytes, many: bytes) -> np.ndarray:
    c = np.frombuffer(few, np.uint8).astype(np.int64)
    c[c == 255] = np.frombuffer(many, np.int64)
    return c


def _answer(table: pa.Table) -> pa.Table:
    """For each block of a range: the counts in the corpus of the n-grams it sent, in the order it sent them."""
    hs = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    cs = [_unpack(a, b) for a, b in zip(table["few"].to_pylist(), table["many"].to_pylist())]
    h, c = np.concatenate(hs), np.concatenate(cs)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in hs])])
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
    total = np.empty(len(h), np.int64)
    if len(h):
        total[order] = np.repeat(np.add.reduceat(c[order], at), np.diff(np.concatenate([at, [len(h)]])))
    cut = [total[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]
    return pa.table({
        "block": table["block"], "range": table["range"], "few": pa.array([np.minimum(t, 255).astype(np.uint8).tobytes() for t in cut], pa.binary()),
        "many": pa.array([t[t >= 255].tobytes() for t in cut], pa.binary()),
    })


def _score(order: int, min_count: int, backoff: float, words_total: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        np.seterr(over="ignore", divide="ignore")
        known, _ = _counted(docs, order)
        # Ranges ascend with hashes, and so do n-grams within a range.
        parts = answers.sort_by("range")
        count = np.concatenate([np.zeros(0, np.int64), *[_unpack(few, many) for few, many in zip(parts["few"].to_pylist(), parts["many"].to_pylist())]])
        if len(count) != len(known):
            raise ValueError("a block's n-grams were answered in part")
        n_words = np.zeros(len(docs), np.int64)
        sums = np.zeros(len(docs))
        hits = np.zeros((len(docs), order), np.int64)
        for w, ends in _grams(*K.column_bytes(docs["text"]), order):
            if not len(w.hash):
                continue
            c = [np.where(h != 0, count[np.minimum(np.searchsorted(known, h), len(known) - 1)], 0) for h in ends]
            log = np.log(c[0] / words_total) + (order - 1) * np.log(backoff)
            level = np.zeros(len(log), np.int64)
            position = np.arange(len(w.hash)) - w.firsts[:-1][w.doc]
            # Near a text's start only shorter contexts exist; they cost no backoff.
            log -= np.log(backoff) * np.maximum(order - 1 - position, 0)
            for n in range(2, order + 1):
                context = np.concatenate([[1], c[n - 2][:-1]])
                use = c[n - 1] >= min_count
                log = np.where(use, np.log(np.maximum(c[n - 1], 1) / np.maximum(context, 1)) + np.log(backoff) * np.minimum(order - n, np.maximum(position - n + 1, 0)), log)
                level = np.where(use, n - 1, level)
            n_words[w.lo : w.hi] = w.counts
            sums[w.lo : w.hi] = np.bincount(w.doc, log, minlength=w.n)
            hits[w.lo : w.hi] = np.bincount(w.doc * order + level, minlength=w.n * order).reshape(w.n, order)
        return pa.table({"doc_id": docs["doc_id"], "n_words": n_words, "log_score": sums, "mean_log_score": pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0), "n_highest": hits[:, order - 1]})

    return run


def score_documents(docs: DataFrame, order: int = 2, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_highest (words scored by the highest order): one row per document."""
    base = common.pick(docs, doc_id="long", text="string")
    total, size = count_words(base)
    blocks = max(1, -(-size // BLOCK_BYTES))
    ranges = max(1, -(-total * order // RANGE_ROWS))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    sent = base.groupBy("block").applyInArrow(_send(ranges, order), "range int, block long, grams binary, few binary, many binary")
    answers = sent.groupBy("range").applyInArrow(_answer, "block long, range int, few binary, many binary")
    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, min_count, backoff, max(total, 1)), "doc_id long, n_words long, log_score double, mean_log_score double, n_highest long")
