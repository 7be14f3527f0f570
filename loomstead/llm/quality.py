"""Quality rules: base rules on words and repetition, then divergence from language references.

Method. A document's characters fall into classes and its words into the common words of the corpus' languages;
both histograms are compared to each language's own by Jensen-Shannon distance (base 2, square root of the
divergence). A document passes with a language where both distances are under their limits; it is kept if one does.
Short texts have noisy histograms: under MIN_CHARS characters in words or MIN_WORDS words the respective test is left out.

References: sums over all documents of a language (rows with null lang take no part), exact: each task counts its words by
language, the counts are summed by word, and words of 1/COMMON or more of a language's tokens are common. The driver gets at most COMMON words
for a language, and refuses more than MAX_LANGUAGES languages. Languages with fewer than MIN_REFERENCE words in all have no reference; documents
labelled with one of them have nothing to diverge from and pass, as all do without any reference.

Edge cases: null or blank text has no words and fails the base rules; repeated rows are judged each; a null doc_id
stays null; other columns are ignored; an empty table gives no rows. Whole texts count, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

_U = np.uint64
COMMON, MIN_REFERENCE, MAX_LANGUAGES = 400, 2_000, 1_000
#: Entries of a task's counts beyond which they are sent on.
HELD = 1_000_000
MIN_CHARS, MIN_WORDS = 200, 60
#: Limits of the Jensen-Shannon distances (0 to 1).
CHAR_LIMIT, WORD_LIMIT = 0.32, 0.46

_CLASSES = 8
_CLASS = np.full(256, 7, np.int64)  # other ASCII
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), map(ord, ".,;:!?'\"()-"), map(ord, "#*$%&|<>"))):
    _CLASS[list(_set)] = _k
_CLASS[0xC0:] = 5  # first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = -1
_CLASS[[0x7B, 0x7D, 0x5B, 0x5D, 0x5F, 0x3D, 0x2B, 0x2F, 0x5C, 0x40, 0x5E, 0x7E, 0x60]] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(map(ord, "#*$%&|<>"))] = True


def char_histogram(w: K.Words) -> np.ndarray:
    """Characters in words by class, documents x classes."""
    inside = ~K.SPACE[w.data]
    kind = _CLASS[w.data]
    doc = np.repeat(np.arange(w.n), np.diff(w.base))
    ok = inside & (kind >= 0)
    return np.bincount(doc[ok] * _CLASSES + kind[ok], minlength=w.n * _CLASSES).reshape(w.n, _CLASSES)


def base_measures(w: K.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    doc_of = np.repeat(np.arange(w.n), np.diff(w.base))
    lead = (w.data & 0xC0) != 0x80
    chars = np.bincount(doc_of[lead & ~K.SPACE[w.data]], minlength=w.n)
    symbols = np.bincount(doc_of[_SYMBOL[w.data]], minlength=w.n)
    # Lines with a word: distinct ones per document are not repeats.
    lines = K.runs(w.data, w.base, 0, w.n, K.NEWLINE, False)
    if len(lines.start):
        held = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
        d, h = lines.doc[held], lines.hash[held]
        _, offsets = K.per_doc_unique(d, h, w.n)
        dup_lines = np.bincount(d, minlength=w.n) - np.diff(offsets)
    else:
        dup_lines = np.zeros(w.n, np.int64)
    keep = K.inside(w.doc, 5)
    windows = K.chain(w.hash, 5)[keep]
    first = np.flatnonzero(keep)
    repeat = np.zeros(len(w.doc), bool)
    if len(windows):
        d = w.doc[first]
        order = np.lexsort((windows, d))
        same = (windows[order][1:] == windows[order][:-1]) & (d[order][1:] == d[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = first[order[twice]]
        for k in range(5):
            repeat[at + k] = True
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(w.doc[repeat], minlength=w.n)}


def fails_base(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _xlogx(p: np.ndarray) -> np.ndarray:
    return p * np.log2(np.where(p > 0, p, 1))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q (both sum to 1), 0 to 1."""
    m = (p + q) / 2
    return np.sqrt(np.clip((_xlogx(p).sum(1) + _xlogx(q).sum()) / 2 - _xlogx(m).sum(1), 0, 1))


_TALLY = "lang string, kind int, word long, n long"
_TOTAL, _WORD, _CHARS = range(3)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: of all words (kind _TOTAL), of each word (_WORD), of each class of characters (_CHARS)."""
    np.seterr(over="ignore")
    chars: dict[str, np.ndarray] = {}
    found: dict[str, list] = {}
    total: dict[str, int] = {}

    def rows(lang: str, kind: int, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(pa.scalar(kind, pa.int32()), len(n)), pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "kind", "word", "n"])

    def reduced(parts: list) -> tuple[np.ndarray, np.ndarray]:
        u, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return u, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(u)).astype(np.int64)

    held = 0
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = K.column_bytes(batch.column(1))
        for w in K.words(data, offsets, lower=True):
            here, hist = langs[w.lo : w.hi], char_histogram(w)
            for lang in set(here):
                mine = here == lang
                chars[lang] = chars.get(lang, 0) + hist[mine].sum(0)
                u, c = np.unique(w.hash[mine[w.doc]], return_counts=True)
                total[lang] = total.get(lang, 0) + int(c.sum())
                found.setdefault(lang, []).append((u, c))
                held += len(u)
            if held > HELD:
                found = {lang: [reduced(parts)] for lang, parts in found.items()}
                held = sum(len(parts[0][0]) for parts in found.values())
                if held > HELD // 2:
                    for lang, parts in found.items():
                        yield rows(lang, _WORD, parts[0][0].view(np.int64), parts[0][1])
                    found, held = {}, 0
    for lang, parts in found.items():
        u, c = reduced(parts)
        yield rows(lang, _WORD, u.view(np.int64), c)
    for lang, n in total.items():
        yield rows(lang, _TOTAL, np.zeros(1, np.int64), np.array([n]))
        yield rows(lang, _CHARS, np.arange(_CLASSES), chars[lang])
    K.settle()


class References:
    """Common words of all languages (sorted hashes), and per language the shares of words and of character classes.

    A word that is common in one language counts in each, with its share there, as the rows have it.
    """

    def __init__(self, rows: list[tuple[str, int, int]], totals: dict[str, int], chars: dict[str, np.ndarray]):
        self.languages = sorted(lang for lang, n in totals.items() if n >= MIN_REFERENCE)
        common_words = sorted({np.uint64(word % 2**64) for lang, word, n in rows if lang in self.languages})
        self.words = np.array(common_words, np.uint64)
        self.word_shares, self.char_shares = [], []
        for lang in self.languages:
            share = np.zeros(len(self.words) + 1)
            for x, word, n in rows:
                if x == lang:
                    at = np.searchsorted(self.words, np.uint64(word % 2**64))
                    if at < len(self.words) and self.words[at] == np.uint64(word % 2**64):
                        share[at] = n / totals[lang]
            share[-1] = max(0.0, 1 - share.sum())
            self.word_shares.append(share / share.sum())
            self.char_shares.append(chars[lang] / max(1, chars[lang].sum()))

    def distances(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances of characters and of words (documents x languages), and numbers of characters."""
        hist = char_histogram(w)
        n_chars = hist.sum(1)
        width = len(self.words) + 1
        at = np.minimum(np.searchsorted(self.words, w.hash), max(0, len(self.words) - 1))
        column = np.where(self.words[at] == w.hash, at, len(self.words)) if len(self.words) else np.zeros(len(w.hash), np.int64)
        counts = np.bincount(w.doc * width + column, minlength=w.n * width).reshape(w.n, width)
        p, c = counts / np.maximum(counts.sum(1, keepdims=True), 1), hist / np.maximum(n_chars, 1)[:, None]
        word = np.array([js_distance(p, q) for q in self.word_shares]).T.reshape(w.n, -1)
        char = np.array([js_distance(c, q) for q in self.char_shares]).T.reshape(w.n, -1)
        return char, word, n_chars

    def verdict(self, lower: K.Words, n_words: np.ndarray, langs: list[str | None], char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passes, nearest language (-1: none), its distances of characters and of words. langs: labels of the documents."""
        if not self.languages:
            nothing = np.zeros(len(n_words))
            return np.ones(len(n_words), bool), np.full(len(n_words), -1), nothing, nothing
        char, word, n_chars = self.distances(lower)
        char_ok = (char <= char_limit) | (n_chars < MIN_CHARS)[:, None]
        word_ok = (word <= word_limit) | (n_words < MIN_WORDS)[:, None]
        best = (char + word).argmin(1)
        row = np.arange(len(best))
        unknown = np.array([x is not None and x not in self.languages for x in langs], bool)
        return (char_ok & word_ok).any(1) | unknown, best, char[row, best], word[row, best]


def references(docs: DataFrame) -> References:
    """References of the languages of docs, from all its labelled rows."""
    rows = common.pick(docs, lang="string", text="string").filter("lang is not null and text is not null")
    sums = common.save(rows.mapInArrow(_tally, _TALLY).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "quality-sums")
    totals = {r["lang"]: r["n"] for r in sums.filter(F.col("kind") == _TOTAL).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = F.broadcast(docs.sparkSession.createDataFrame([(x, int(n)) for x, n in totals.items() if n >= MIN_REFERENCE], "lang string, total long"))
    known = sums.join(each, "lang")
    common_words = known.filter((F.col("kind") == _WORD) & (F.col("n") * COMMON >= F.col("total"))).select("word").distinct()
    # At most COMMON words for a language, with their counts in all.
    kept = known.filter(F.col("kind") == _WORD).join(F.broadcast(common_words), "word").select("lang", "word", "n").collect()
    chars: dict[str, np.ndarray] = {}
    for r in known.filter(F.col("kind") == _CHARS).collect():
        chars.setdefault(r["lang"], np.zeros(_CLASSES))[r["word"]] = r["n"]
    common.forget(sums)
    return References([tuple(r) for r in kept], totals, chars)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(refs: References, data: np.ndarray, offsets: np.ndarray, langs: list[str | None]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(measures, fails base, kept, nearest language, distances) of each chunk of documents."""
    np.seterr(over="ignore")
    for w in K.words(data, offsets):
        m = base_measures(w)
        failed = fails_base(m)
        passed, best, char, word = refs.verdict(K.runs(data, offsets, w.lo, w.hi, K.SPACE, True), m["n_words"], langs[w.lo : w.hi])
        yield m, failed, ~failed & passed, best, char, word


def _assess(refs: References):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for m, failed, kept, best, char, word in judge(refs, *K.column_bytes(batch.column(1)), batch.column(2).to_pylist()):
                n = len(failed)
                names = [refs.languages[b] if b >= 0 else None for b in best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), *[pa.array(m[c].astype(np.int64)) for c in _MEASURES], pa.array(failed), pa.array(kept), pa.array(names, pa.string()), pa.array(char), pa.array(word)],
                    names=["doc_id", *_MEASURES, "base_failed", "kept", "nearest_lang", "char_distance", "word_distance"],
                )
                at += n
        K.settle()

    return run


def assess(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the nearest language with its distances."""
    refs = refs or references(docs)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _MEASURES) + ", base_failed boolean, kept boolean, nearest_lang string, char_distance double, word_distance double"
    return common.pick(docs, doc_id="long", text="string", lang="string").mapInArrow(_assess(refs), schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all columns."""
    from .rowflag import keep_where

    refs = references(docs)
    at = docs.columns.index("lang") if "lang" in docs.columns else None

    def decide(data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        langs = batch.column(at).cast(pa.string()).to_pylist() if at is not None else [None] * batch.num_rows
        return np.concatenate([k for _, _, k, *_ in judge(refs, data, offsets, langs)] or [np.zeros(0, bool)])

    return keep_where(docs, decide)
