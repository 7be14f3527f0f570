"""SentencePiece encoding and decoding in batched numpy: Viterbi, for unigram and for BPE models.

Cuts of about equal length advance together, one end position at a time; the hashes of all substrings that end there probe
the sorted hashes of the pieces, and vectorised maxima keep the best way to reach the position and the back-pointer.

Unigram models: a way's worth is its sum of scores.

BPE models merge by rank, and the best sum of scores isn't what their merges give. But every prefix of a text has one
encoding by merges, and a row of pieces is the encoding of its text if and only if that holds of each two neighbours. So a
way's worth is 0 if its last two pieces are such neighbours, and minus infinity otherwise: at each position one way is left,
and the back-pointers give the merges' ids exactly. Whether two pieces are neighbours is read off the pieces' own merges
(`Model.neighbours`), by undoing them from the last one back and looking for a merge across the border that would have come first.

No piece spans the start of a run of blanks, nor a line break, so texts are cut there; equal cuts are encoded once
and kept in a table of bounded size. The library is used to read the model file's pieces, not to encode.

Edge cases: null or empty text has no ids; characters without a piece become byte pieces (or <unk> in models without
them); decoding gives the text back but for what <unk> hides, and the sign that stands for a blank; null ids decode to null text; repeated rows are encoded
each; an empty table gives no rows; other columns are ignored. Normalisation other than `identity` is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K
from .bpe import merge_rows
from .idtable import IdTable, Probe

SPACE = "▁"
#: Bytes of text whose cuts are looked up together; characters of a cut that is walked alone; steps of lengths that advance together.
TOGETHER, LONG = 3_000_000, 192
_STEPS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, LONG])
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NO_PIECE = 1 << 30


class Model:
    """Pieces and scores; kind is `bpe` or `unigram`."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], kind: str):
        self.pieces, self.kind = pieces, kind
        self.scores = np.array(scores, np.float64)
        normal = {p: k for k, p in enumerate(pieces) if types[k] not in (_UNKNOWN, _CONTROL, _BYTE)}
        self.byte = np.full(256, types.index(_UNKNOWN), np.int64)
        for k, p in enumerate(pieces):
            if types[k] == _BYTE:
                self.byte[int(p[3:5], 16)] = k
        self.has_bytes = _BYTE in types
        self.unk = types.index(_UNKNOWN)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("pieces span blanks or lines")
        if kind == "bpe":
            normal = self._merges(normal)
        with np.errstate(over="ignore"):
            mixed = K.mix(np.array([self._hash(p) for p in normal], np.uint64))
        order = np.argsort(mixed)
        self.piece_probe, self.piece_id = Probe(mixed[order]), np.array(list(normal.values()), np.int64)[order]
        self.longest = max(map(len, normal))
        self.unk_score = float(self.scores[list(normal.values())].min()) - 10.0
        said = [b"" if types[k] == _CONTROL else " ⁇ ".encode() if types[k] == _UNKNOWN else bytes([int(p[3:5], 16)]) if types[k] == _BYTE else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for k, p in enumerate(pieces)]
        self.said_at = np.cumsum([0, *map(len, said)])
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def _merges(self, normal: dict[str, int]) -> dict[str, int]:
        """Pairs that merge, with ranks, and the last merge of each piece; gives the pieces that their own text is encoded as."""
        pairs = {}
        for p, k in normal.items():
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = k
        self.pair_keys = np.array(sorted(pairs), np.int64)
        made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        rank = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)  # least first; equal scores are equal ranks
        self.pair_rank = rank[made]
        self.rank = np.full(len(self.pieces), -1, np.int64)  # of the merge that makes a piece; characters are there from the start
        self.left, self.right = np.full((2, len(self.pieces)), -1, np.int64)
        out, by_length = {p: k for p, k in normal.items() if len(p) == 1}, {}
        for p, k in normal.items():
            if all(c in out for c in p):
                by_length.setdefault(len(p), []).append((p, k))
        for length in sorted(x for x in by_length if x > 1):
            some = by_length[length]
            ids = np.array([[out[c] for c in p] for p, _ in some], np.int64)
            n = merge_rows(ids, self.pair_keys, self.pair_rank, made, stop=2)
            for (p, k), (a, b), size in zip(some, ids[:, :2].tolist(), n.tolist()):
                if size == 2 and pairs.get(a << 32 | b) == k:
                    out[p], self.left[k], self.right[k], self.rank[k] = k, a, b, rank[k]
        whole = np.flatnonzero(self.left >= 0)
        self.late = np.zeros(len(self.pieces), bool)  # no earlier than a piece they are merged from: runs of blanks, whose scores are equal
        self.late[whole] = np.maximum(self.rank[self.left[whole]], self.rank[self.right[whole]]) >= self.rank[whole]
        self.char = {p: k for p, k in out.items() if len(p) == 1}
        self.made, self.known = made, {}
        with np.errstate(over="ignore"):
            mixed = K.mix(self.pair_keys.view(np.uint64))
        order = np.argsort(mixed)
        self.pair_probe = Probe(mixed[order])
        self.probed_rank = np.append(self.pair_rank[order], np.iinfo(np.int64).max)  # the last one: no such pair
        return out

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True for each two pieces (a[k], b[k]) that the text of both is encoded as.

        Going back in time, the later of the two last merges is undone (of equals the right one, as the left is made first); on
        the way each pair that meets at the border must have no merge of its own that comes before its sides grow on.
        This holds where a piece ranks after the pieces it is made of; the others (`late`) are merged.
        """
        ok = np.ones(len(a), bool)
        late = self.late[a] | self.late[b]
        if late.any():
            ok[late] = self._by_merges(a[late], b[late])
        live = np.flatnonzero(~late)
        x, y = a[live], b[live]
        no = np.iinfo(np.int64).max
        until_x, until_y = np.full(len(live), no), np.full(len(live), no)
        while len(live):
            rank = self.probed_rank[self.pair_probe.find(K.mix((x << 32 | y).view(np.uint64)))]
            joins = (rank < until_x) & (rank <= until_y)
            ok[live[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joins & ((rx >= 0) | (ry >= 0))
            x, y, rx, ry, live, until_x, until_y = (v[go] for v in (x, y, rx, ry, live, until_x, until_y))
            right = ry >= rx
            until_y = np.where(right, ry, until_y)
            until_x = np.where(right, until_x, rx)
            x, y = np.where(right, x, self.right[x]), np.where(right, self.left[y], y)
        return ok

    def _by_merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same by merging the text of both: for the few pieces of which going back tells nothing."""
        out = np.zeros(len(a), bool)
        if len(self.known) > 100_000:
            self.known = {}
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            if (x, y) not in self.known:
                ids = np.array([[self.char[c] for c in self.pieces[x] + self.pieces[y]]], np.int64)
                n = merge_rows(ids, self.pair_keys, self.pair_rank, self.made)
                self.known[x, y] = ids[0, : n[0]].tolist() == [x, y]
            out[k] = self.known[x, y]
        return out

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("only identity normalisation with a dummy prefix is read")
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        return cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], kind)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def encode_cuts(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts, one cut's after another's, and the number of ids of each. code: code points; sizes: of each cut."""
        first = np.cumsum(sizes) - sizes
        step = _STEPS[np.minimum(np.searchsorted(_STEPS, sizes), len(_STEPS) - 1)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # cuts, places from the end on, ids
        for width in np.unique(step[sizes <= LONG]).tolist():
            every = np.flatnonzero((step == width) & (sizes <= LONG))
            count = max(1, 100_000 // width)
            for lo in range(0, len(every), count):
                rows = every[lo : lo + count]
                column = np.arange(width)
                there = column < sizes[rows][:, None]
                part = np.where(there, code[np.minimum(first[rows][:, None] + column, len(code) - 1)], _NO_PIECE)
                found.append(self._walk_back(rows, sizes[rows], part, *self._viterbi(part)))
        for k in np.flatnonzero(sizes > LONG).tolist():
            part = code[first[k] : first[k] + sizes[k]]
            back, piece = self._long(part)
            found.append(self._walk_back(np.array([k]), sizes[[k]], part[None], back[None], piece[None]))
        cut, place, ids = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        n = np.bincount(cut, minlength=len(sizes)).astype(np.int64)
        out = np.zeros(len(ids), np.int64)
        out[(np.cumsum(n) - 1)[cut] - place] = ids
        return out, n

    def _hashes(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, length = code.shape
        c = code.astype(np.uint64) + _U(1)
        prefix = np.zeros((m, length + 1), np.uint64)
        power = np.cumprod(np.array([1] + [_BASE] * self.longest, np.uint64))
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * _U(_BASE) + c[:, k]
        return prefix, power

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Pieces of hashes; -1 where there is none."""
        at = self.piece_probe.find(K.mix(h))
        return np.where(at >= 0, self.piece_id[at], -1)

    def _viterbi(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-pointers and last pieces (-1: a character without a piece) of each end position, for rows of equal length."""
        m, length = code.shape
        prefix, power = self._hashes(code)
        best = np.full((m, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((m, length + 1), np.int64)
        piece = np.full((m, length + 1), -1, np.int64)
        row = np.arange(m)
        for end in range(1, length + 1):
            sizes = np.arange(min(end, self.longest), 0, -1)  # of equal sums the longest last piece wins, as in the library
            starts = end - sizes
            p = self._probe(prefix[:, end][:, None] - prefix[:, starts] * power[sizes])
            if self.kind == "bpe":
                score = np.where(p >= 0, np.float32(0), -np.inf)
                r, c = np.nonzero(p >= 0)
                before = np.where(starts[c] > 0, piece[r, starts[c]], -1)
                r, c, before = r[before >= 0], c[before >= 0], before[before >= 0]  # nothing merges across a character without a piece
                score[r, c] = np.where(self.neighbours(before, p[r, c]), 0, -np.inf)
                score[:, -1] = np.where((score == -np.inf).all(1), 0, score[:, -1])
            else:
                score = np.where(p >= 0, self.scores[p], -np.inf).astype(np.float32)
                score[:, -1] = np.where(p[:, -1] >= 0, score[:, -1], self.unk_score)
            total = best[:, starts] + score
            pick = total.argmax(1)
            best[:, end], back[:, end], piece[:, end] = total[row, pick], starts[pick], p[row, pick]
        return back, piece

    def _long(self, code: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long cut, whose substrings are probed by blocks of end positions."""
        n, width = len(code), self.longest
        back, piece = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        best = [0.0] + [-np.inf] * n
        known: dict[int, bool] = {}
        scores = self.scores.tolist()
        for lo in range(0, n, block):
            hi, base = min(n, lo + block), max(0, lo - width)
            prefix, power = self._hashes(code[None, base:hi])
            prefix = prefix[0]
            ends = np.arange(lo + 1, hi + 1)
            table = np.full((hi - lo, width + 1), -1, np.int64)
            for size in range(1, min(width, hi) + 1):
                at = ends[ends >= size]
                table[at - lo - 1, size] = self._probe(prefix[at - base] - prefix[at - size - base] * power[size])
            row, column = np.nonzero(table >= 0)
            p = table[row, column]
            order = np.lexsort((-column, row))  # longest first
            edges = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
            column, p = column[order].tolist(), p[order].tolist()
            for end in range(lo + 1, hi + 1):
                top, start, last = -np.inf, end - 1, -1
                for k in range(edges[end - lo - 1], edges[end - lo]):
                    s, q = end - column[k], p[k]
                    if self.kind == "bpe":
                        before = int(piece[s]) if s else -1
                        key = before << 32 | q
                        if before >= 0 and key not in known:
                            known[key] = bool(self.neighbours(np.array([before]), np.array([q]))[0])
                        if before < 0 or known[key]:
                            top, start, last = 0.0, s, q
                            break
                    elif best[s] + scores[q] > top:
                        top, start, last = best[s] + scores[q], s, q
                if self.kind != "bpe" and (last < 0 or column[edges[end - lo] - 1] != 1) and best[end - 1] + self.unk_score > top:
                    top, start, last = best[end - 1] + self.unk_score, end - 1, -1
                best[end], back[end], piece[end] = top, start, last
        return back, piece

    def _walk_back(self, rows: np.ndarray, sizes: np.ndarray, code: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cut, place counted from the cut's end, id): pieces along the back-pointers; characters without a piece as their bytes."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        end, place, live = sizes.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            at = end[live]
            p = piece[live, at]
            ok = p >= 0
            out.append((rows[live[ok]], place[live[ok]], p[ok]))
            place[live[ok]] += 1
            for k, c in zip(live[~ok].tolist(), code[live[~ok], at[~ok] - 1].tolist()):
                ids = self.byte[list(chr(c).encode("utf-8", "surrogatepass"))][::-1] if self.has_bytes else np.array([self.unk])
                out.append((np.full(len(ids), rows[k]), place[k] + np.arange(len(ids)), ids))
                place[k] += len(ids)
            end[live] = back[live, at]
            live = live[end[live] > 0]
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.int64),) * 3

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, with the blank at the start."""
        n = self.said_at[ids + 1] - self.said_at[ids]
        ends = np.cumsum(n)
        return self.said[np.repeat(self.said_at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Codec:
    """Encoder and decoder of texts given as bytes and offsets; ids of cuts are kept in a table of bounded size."""

    def __init__(self, model: Model):
        self.model, self.table = model, IdTable()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the number of ids of each, and whether decoding gives the text back."""
        n = len(offsets) - 1
        sign = np.frombuffer(SPACE.encode(), np.uint8)
        hit = np.flatnonzero((data[:-2] == sign[0]) & (data[1:-1] == sign[1]) & (data[2:] == sign[2])) if len(data) > 2 else np.zeros(0, np.int64)
        hidden = np.zeros(n, bool)
        if len(hit):  # the sign itself is encoded as a blank
            hidden[np.searchsorted(offsets[1:], hit, "right")] = True
            data = data.copy()
            data[hit] = 32
            offsets = offsets - 2 * np.searchsorted(hit, offsets)
            data = np.delete(data, np.concatenate([hit + 1, hit + 2]))
        some = np.flatnonzero(np.diff(offsets) > 0)
        base = np.concatenate([offsets[some], offsets[-1:]])
        text = np.insert(data, base[:-1], 32)
        base = base + np.arange(len(base))
        keys, starts, ends = [], [], []
        for lo, hi in K.chunks(base):
            part = text[base[lo] : base[hi]]
            blank, line = part == 32, part == 10
            begins = line.copy()
            begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
            begins[base[lo:hi] - base[lo]] = True
            s = np.flatnonzero(begins)
            e = np.append(s[1:], len(part))
            keys.append(K.hash_ranges(part, s, e))
            starts.append(s + base[lo])
            ends.append(e + base[lo])
        if not keys:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), ~hidden
        start, end = np.concatenate(starts), np.concatenate(ends)
        ids, count = self.table.resolve(np.concatenate(keys), lambda at: self._learn(text, start[at], end[at]))
        doc = np.searchsorted(base[1:], start, "right")
        each = np.zeros(n, np.int64)
        each[some] = np.bincount(doc, count, minlength=len(some)).astype(np.int64)
        same = ~hidden
        said = self.model.decode(ids)
        if len(said) != len(text) or (said != text).any():
            at = np.concatenate([[0], np.cumsum(each)])
            for j, k in enumerate(some.tolist()):
                same[k] &= np.array_equal(self.model.decode(ids[at[k] : at[k + 1]]), text[base[j] : base[j + 1]])
        return ids, each, same

    def _learn(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        flat = text[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        heads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        ends = np.cumsum(size)
        code = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 32] = ord(SPACE)
        return self.model.encode_cuts(code, heads[ends] - heads[ends - size])

    def decode(self, ids: np.ndarray) -> str:
        text = self.model.decode(ids).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """One codec in a Python worker, whose table serves task after task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(Model.load(path))
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip, and ids (array<int>) if they are kept.

    round_trip tells whether decoding gives the text back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        codec = codec_of(model_path)
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi in K.chunks(offsets, TOGETHER):
                ids, n, same = codec.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.concatenate([[0], np.cumsum(n)])
                held = memoryview(ids.astype("<u4").view(np.uint8)) if len(ids) else memoryview(b"")
                crc = [zlib.crc32(held[a:b]) for a, b in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist())]
                columns, names = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        K.settle()

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text: of doc_id and ids. Null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            texts = [None if x.values is None else codec.decode(x.values.to_numpy().astype(np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
