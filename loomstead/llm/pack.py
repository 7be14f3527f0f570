"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: large-item matching. Pieces above a third of the capacity go at most two to a bin, paired greedily from
the longest on, each with the longest that still fits; shorter pieces then go, longest first, where the gap is
smallest. A piece matters only by its length, so the plan is made from the histogram of lengths: at most
`capacity` rows, whatever the number of documents. Bins filled alike are one row of the plan with a
multiplicity, and equal pieces are spread over them by their rank, so that no task holds a bin list.

Steps: (1) token ids of each document, cut into pieces, in one pass; ids of words are kept in a table of bounded size.
(2) histogram to the driver, plan back as a table of bounded size. (3) ranks of pieces within their length,
numbered in sub-groups, no group in one task. (4) rank to bin by lookup.

Edge cases: null or empty text is the single end id; a text above capacity is cut into full pieces and a last
one; rows that repeat are packed each; a null doc_id is packed and stays null; other columns are ignored; an empty
table gives no rows. Cost is one pass over the texts, and then rows of about 40 bytes per piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K
from .bpe import merge_rows
from .idtable import IdTable

_PIECES = "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text whose parts are looked up together, and of the longest run between blanks that is split here.
TOGETHER, LONG = 1_500_000, 96

_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x21:0x7F] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Parts:
    """Parts of texts, as the tokenizer splits them: runs of letters, single digits, runs of other signs, and 's, 't, 're, 've, 'm, 'll, 'd.

    Runs between blanks with anything beyond ASCII and the letters of Latin-1, with a special token's mark, or longer than
    LONG are parts as a whole, which the library encodes (`odd`). `raw`: bytes as they are, `low`: in lower case.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        # A blank after each text: nothing crosses two of them; some more at the end, to look ahead.
        raw = np.concatenate([np.insert(data, offsets[1:], 32), np.full(4, 32, np.uint8)])
        low, kind = _LOWER[raw], _KIND[raw]
        bad = kind == _ODD
        if (raw >= 0x80).any():
            after = np.zeros(len(raw), bool)
            lead = raw == 0xC3
            after[1:] = lead[:-1]
            bad |= (raw >= 0x80) & ~lead & ~after | after & ((raw == 0x97) | (raw == 0xB7))
            low[after & (raw < 0x9F)] += 32
        word = kind != _BLANK
        before = np.zeros(len(raw), np.uint8)
        before[1:] = kind[:-1]
        opens = word & (before == _BLANK)
        opens[0] = word[0]
        begins = word & ((kind != before) | (kind == _DIGIT))
        begins[0] = word[0]
        tick = np.flatnonzero((low == 39) & (before != _OTHER))
        one, two = low[tick + 1], low[tick + 2]
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
        for a, b in (b"re", b"ve", b"ll"):
            size[(one == a) & (two == b)] = 3
        tick, size = tick[size > 0], size[size > 0]
        begins[tick + 1] = False
        begins[(tick + size)[kind[tick + size] == _LETTER]] = True
        first = np.flatnonzero(opens)
        chunk = np.cumsum(opens) - 1
        closes = np.zeros(len(raw), bool)
        closes[:-1] = word[:-1] & ~word[1:]
        whole = np.flatnonzero(closes) + 1 - first > LONG
        whole[chunk[np.flatnonzero(bad)]] = True
        whole[chunk[np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))]] = True
        if whole.any():
            inside = word & whole[np.maximum(chunk, 0)]
            begins = np.where(inside, opens, begins)
        ends = word.copy()
        ends[:-1] &= begins[1:] | ~word[1:]
        self.raw, self.low = raw, low
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.odd = whole[chunk[self.start]] if len(self.start) else np.zeros(0, bool)
        base = offsets + np.arange(n + 1)
        self.doc = np.searchsorted(base[1:], self.start, "right")
        self.key = K.hash_ranges(low, self.start, self.end)
        if self.odd.any():
            self.key[self.odd] = K.mix(K.hash_ranges(raw, self.start[self.odd], self.end[self.odd]) + np.uint64(1))


class WordEncoder:
    """Ids of texts: parts are looked up by hash, and new ones of equal length merged together in numpy by the merges of the
    tokenizer's own file; odd parts are encoded by the library. Tests hold all of it against the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        steps = [x.get("type") for x in spec["normalizer"]["normalizers"]] if spec.get("normalizer", {}).get("normalizers") else []
        if steps != ["NFC", "Replace", "Lowercase"] or not suffix or spec["model"].get("ignore_merges"):
            raise ValueError("only lower-casing word BPE with word ends is read")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        table = {vocab[a] << 32 | vocab[b]: (k, vocab[a + b]) for k, (a, b) in reversed(list(enumerate(pairs)))}
        keys = sorted(table)
        self.keys = np.array(keys, np.int64)
        self.rank = np.array([table[k][0] for k in keys], np.int64)
        self.new = np.array([table[k][1] for k in keys], np.int64)
        # Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in keep)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int64)
        self.table = IdTable()

    def _learn(self, raw: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one part's after another's, and the number of ids of each part."""
        sizes, found = np.zeros(len(start), np.int64), []
        length = np.where(odd, 0, end - start)
        for x in np.unique(length[~odd]).tolist():
            every = np.flatnonzero(length == x)
            step = max(1, 200_000 // x)
            for lo in range(0, len(every), step):
                rows = every[lo : lo + step]
                part = low[start[rows][:, None] + np.arange(x)]
                ids = self.inner[part]
                ids[:, -1] = self.last[part[:, -1]]
                sizes[rows] = n = merge_rows(ids, self.keys, self.rank, self.new)
                found.append((rows, ids[np.arange(x) < n[:, None]]))
        rows = np.flatnonzero(odd)
        for lo in range(0, len(rows), 2_000):
            some = rows[lo : lo + 2_000]
            texts = [raw[start[k] : end[k]].tobytes().decode() for k in some]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes[some] = [len(x) for x in ids]
            found.append((some, np.array([y for x in ids for y in x], np.int64)))
        out, at = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for rows, ids in found:
            n = sizes[rows]
            out[np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each."""
        counts = np.zeros(len(offsets) - 1, np.int64)
        cuts = [(lo, hi, Parts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in K.chunks(offsets)]
        if not cuts:
            return np.zeros(0, np.uint32), counts
        shift = np.cumsum([0, *(len(p.raw) for _, _, p in cuts)])
        joined = lambda name, by=None: np.concatenate([getattr(p, name) + (0 if by is None else by[k]) for k, (_, _, p) in enumerate(cuts)])
        raw, low, start, end = joined("raw"), joined("low"), joined("start", shift), joined("end", shift)
        odd, key, doc = np.concatenate([p.odd for _, _, p in cuts]), np.concatenate([p.key for _, _, p in cuts]), joined("doc", [lo for lo, _, _ in cuts])
        del cuts
        ids, n = self.table.resolve(key, lambda at: self._learn(raw, low, start[at], end[at], odd[at]))
        counts += np.bincount(doc, n, minlength=len(counts)).astype(np.int64)
        return ids, counts


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder in a Python worker, as its file is read slowly; its table of parts is a task's own."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(make_encoder: Callable[[], WordEncoder], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        encoder = make_encoder()
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(2))
            for lo, hi in K.chunks(offsets, TOGETHER):
                ids, n = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                every = np.full(len(ids) + len(n), end_id, "<u4")
                every[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n = n + 1
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = 4 * ((np.cumsum(n) - n)[row] + start)
                held = memoryview(every.view(np.uint8))
                crc = [zlib.crc32(held[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                take = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "text_hash", "piece", "start", "length", "ids_crc32"],
                )
        encoder.table.clear()  # workers are reused by other stages
        K.settle()

    return run


class _Gaps:
    """Numbers of bins by gap, with the next larger gap found by bisection."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[list]] = {}

    def add(self, gap: int, bins: int, items: tuple) -> None:
        self.by_gap.setdefault(gap, []).append([bins, items])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins as (number of bins, ((length, pieces of it), ...)): matching of large pieces, then best fit.

    Equal lengths are taken together: filling one gap with as many as fit, gap after gap, is what best fit does
    with them one by one.
    """
    if any(x < 1 or x > capacity for x in histogram):
        raise ValueError("lengths must lie within 1..capacity")
    left = {x: n for x, n in histogram.items() if n > 0}
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    gaps = _Gaps()
    for x in large:
        while left[x]:
            partner = next((y for y in large if y <= x and left[y] and x + y <= capacity and (y != x or left[x] > 1)), None)
            if partner is None:
                gaps.add(capacity - x, left[x], ((x, 1),))
                left[x] = 0
            elif partner == x:
                n = left[x] // 2
                gaps.add(capacity - 2 * x, n, ((x, 2),))
                left[x] -= 2 * n
            else:
                n = min(left[x], left[partner])
                gaps.add(capacity - x - partner, n, ((x, 1), (partner, 1)))
                left[x] -= n
                left[partner] -= n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[x]
        fitting = sorted(g for g in gaps.by_gap if g >= x)
        for g in fitting:
            if not n:
                break
            classes = gaps.by_gap.pop(g)
            each = g // x
            for k, (bins, items) in enumerate(classes):
                full = min(bins, n // each)
                rest = min(each - 1, n - full * each) if full < bins else 0
                if full:
                    gaps.add(g - each * x, full, (*items, (x, each)))
                if rest:
                    gaps.add(g - rest * x, 1, (*items, (x, rest)))
                same = bins - full - (rest > 0)
                n -= full * each + rest
                if same:
                    gaps.add(g, same, items)
                if not n:
                    for other in classes[k + 1 :]:
                        gaps.by_gap.setdefault(g, []).append(other)
                    break
        if n:
            each = capacity // x
            if n // each:
                gaps.add(capacity - each * x, n // each, ((x, each),))
            if n % each:
                gaps.add(capacity - (n % each) * x, 1, ((x, n % each),))
    return [(bins, items) for g in sorted(gaps.by_gap) for bins, items in gaps.by_gap[g]]


def slots(bins: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """Rows (length, first rank, ranks, each, first bin, offset): where the pieces of a length and rank go.

    Of `ranks` pieces from `first rank` on, `each` in turn share a bin, side by side from `offset`.
    """
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for n, items in bins:
        offset = 0
        for length, each in items:
            rank = used.get(length, 0)
            rows.append((length, rank, n * each, each, first_bin, offset))
            used[length] = rank + n * each
            offset += length * each
        first_bin += n
    return np.array(rows, np.int64).reshape(-1, 6)


def _place(table: np.ndarray):
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(table[:, 1].max(initial=0)) + int(table[:, 2].max(initial=0)) + 1
        keys = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            t = table[np.searchsorted(keys, length * width + rank, "right") - 1]
            k = rank - t[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(t[:, 4] + k // t[:, 3]), pa.array(t[:, 5] + k % t[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece, all documents packed."""
    spark = docs.sparkSession
    base = common.pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    pieces = common.save(base.mapInArrow(token_pieces(lambda: word_encoder(tokenizer_path), capacity, end_id), _PIECES), "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    ranked = common.number_within(pieces, ["length"], ["doc_id", "text_hash", "piece"], "rank")
    out = ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out if counts else common.empty(spark, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
