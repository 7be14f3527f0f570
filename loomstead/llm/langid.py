"""Language identification by error-correcting output codes.

Method: each language has a codeword; for each bit a binary classifier over byte n-grams tells the languages
with a 1 from those with a 0. Decoding sums, over the bits, the logistic loss of the classifier's margin against
the codeword's bit, weighted by how well the bit was told on training rows, and takes the nearest codeword. A
document whose second codeword is almost as near is flagged as ambiguous.

Codewords: up to 6 languages use the exhaustive code (2 ** (k - 1) - 1 bits, every pair differs in half of them or
more); more use random balanced bits with the best least distance of several draws, by a fixed seed. The bit classifiers are
log odds of n-gram frequencies, averaged over the languages of each side, so that no language counts more for being
frequent. They are fitted from counts over all labelled rows, summed where the rows are; the driver gets languages x features counts.

Labels are read in fitting alone: rows with null label, and held-out rows, take no part. A prediction reads the text only.

Edge cases: null text, or one without a letter, is `und` with score 0; without any labelled row all are `und`; a text
of one letter is predicted; rows that repeat are predicted each; null doc_id counts as held out = false, its checksum being none;
other columns are ignored. Texts are read whole; no prefix is taken.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

_U = np.uint64
BITS = 14
FEATURES = 1 << BITS
#: Counts of a language are 128 KB on the driver; with more languages than this, fitting is refused.
MAX_LANGUAGES = 1_000
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0x09, 0x0E), *range(48, 58)]] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, feature of each place, offsets of documents in them): hashed byte 4-grams and 2-grams of documents lo..hi.

    Each document is framed by blanks, one before and three after it, and has a gram for its length and one more places, so none crosses two of them.
    """
    for lo, hi in K.chunks(offsets, 1 << 18):
        n = hi - lo
        lengths = np.diff(offsets[lo : hi + 1])
        out = np.full(int(lengths.sum()) + 4 * n, 32, np.uint32)
        place = np.arange(int(lengths.sum())) + np.repeat(4 * np.arange(n) + 1, lengths)
        out[place] = _FOLD[data[offsets[lo] : offsets[hi]]]
        two = out[:-3] << 8 | out[1:-2]
        four = two << 16 | out[2:-1] << 8 | out[3:]
        f2 = (two * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS + 1)
        f4 = ((four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS + 1)
        own = np.arange(int(lengths.sum()) + n) + np.repeat(3 * np.arange(n), lengths + 1)
        feature = np.empty(2 * len(own), np.int32)
        feature[0::2] = f2[own]
        feature[1::2] = f4[own] + FEATURES // 2
        yield lo, hi, feature, 2 * np.concatenate([[0], np.cumsum(lengths + 1)])


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each text with a letter of any script. Memory is a few bytes for each byte of a chunk, not of the batch."""
    out = np.zeros(len(offsets) - 1, bool)
    for lo, hi in K.chunks(offsets, 1 << 18):
        full = np.flatnonzero(offsets[lo + 1 : hi + 1] > offsets[lo:hi])
        if len(full):  # empty texts have no place of their own in the bytes
            letter = _ASCII_LETTER[data[offsets[lo] : offsets[hi]]]
            out[lo + full] = np.logical_or.reduceat(letter, offsets[lo + full] - offsets[lo])
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = _letter_beyond_ascii(data[offsets[k] : offsets[k + 1]])
    return out


def _letter_beyond_ascii(data: np.ndarray) -> bool:
    """Some KB at a time: most texts have a letter among the first characters."""
    if not (data >= 0x80).any():
        return False
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return any(c.isalpha() for lo in range(0, len(data), 4096) for c in reader.decode(data[lo : lo + 4096].tobytes()))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1, distinct, no constant column."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        columns = [[1] + [1 if c >> j & 1 else -1 for j in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, float).T
    rng, width = np.random.default_rng(seed), int(10 * np.ceil(np.log2(k)))
    best, least = None, -1.0
    for _ in range(50):
        code = np.array([rng.permutation(np.resize([1.0, -1.0], k)) for _ in range(width)]).T
        distance = ((code[:, None] != code[None]).sum(2) + 10**6 * np.eye(k)).min()
        if distance > least:
            best, least = code, distance
    return best


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = K.column_bytes(batch.column(1))
        for lo, hi, feature, at in grams(data, offsets):
            here = langs[lo:hi]
            for lang in set(here):
                rows = np.flatnonzero(here == lang)
                mask = np.zeros(hi - lo, bool)
                mask[rows] = True
                part = feature[np.repeat(mask, np.diff(at))] if len(rows) < hi - lo else feature
                counts[lang] = counts.get(lang, 0) + np.bincount(part, minlength=FEATURES)
    for lang, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.astype("<i8").tobytes()])], names=["lang", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table["counts"].to_pylist())
    return pa.table({"lang": table["lang"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


class Model:
    """languages, codewords (k x bits), weights (features x bits), bias (bits), bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages = languages
        self.code = codewords(len(languages))
        self.ambiguous_below = 0.02
        if len(languages) > 1:
            p = np.empty(counts.shape)
            half = FEATURES // 2
            for part in (slice(0, half), slice(half, FEATURES)):
                c = counts[:, part] + smooth
                p[:, part] = c / c.sum(1, keepdims=True)
            ones, zeros = (self.code > 0).astype(float), (self.code < 0).astype(float)
            self.weights = np.log((ones / ones.sum(0)).T @ p).T - np.log((zeros / zeros.sum(0)).T @ p).T
            # How far each bit's expected margin separates the two sides: its weight in decoding.
            margin = p @ self.weights
            self.bit_weight = np.maximum((margin * self.code).min(0), 1e-3)
            self.bit_weight /= self.bit_weight.sum()
            self.weights = self.weights.astype(np.float32)
        else:
            self.weights, self.bit_weight = np.zeros((FEATURES, 1), np.float32), np.ones(1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score in 0..1, and whether it is ambiguous, for rows of margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weight
        best = loss.argmin(1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        score = p[np.arange(len(best)), best]
        rest = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(best))
        return best, score, score - rest < self.ambiguous_below

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        letters = has_letter(data, offsets)
        margins = np.zeros((n, self.weights.shape[1]))
        for lo, hi, feature, at in grams(data, offsets):
            for bit in range(self.weights.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[:, bit][feature], dtype=np.float64)])
                margins[lo:hi, bit] = sums[at[1:]] - sums[at[:-1]]
        # Neighbouring grams repeat each other's evidence.
        best, score, unclear = self.decode(margins / 4) if self.languages else (np.zeros(n, int), np.zeros(n), np.ones(n, bool))
        if not self.languages:
            letters[:] = False
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0), np.where(letters, unclear, True)


def fit(docs: DataFrame) -> Model:
    """Model from the text and label of all labelled rows that aren't held out."""
    rows = common.pick(docs, doc_id="long", text="string", lang="string").filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInArrow(_sum, "lang string, counts binary")
    found = sorted((r["lang"], r["counts"]) for r in counted.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Model([x for x, _ in found], np.array([np.frombuffer(c, "<i8") for _, c in found], float))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(2))
            lang, score, unclear = model.predict(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per document."""
    model = model or fit(docs)
    base = common.pick(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return base.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """docs without those of no language: `und`. Rows keep all columns; texts are read once for the decision."""
    from loomstead.llm.rowflag import keep_where

    model = fit(docs)
    return keep_where(docs, lambda data, offsets, batch: np.array([x != "und" for x in model.predict(data, offsets)[0]], bool))


def crc_remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
