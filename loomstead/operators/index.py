"""Index tables and ranked search over blocks: postings, statistics, BM25, TF-IDF, dense and hybrid scores.

blocks: (key, text, ...). Statistics are of the whole corpus, also where a search is filtered. A corpus that is searched often
is indexed once (`build`, written partitioned by term hash); `bm25` alone needs one pass and one aggregation by key.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X
from loomstead.operators import parse

K1, B = 1.5, 0.75


@dataclass
class Index:
    """postings(key, term, tf), terms(term, df, cf), lengths(key, dl), stats(n, avgdl: one row)."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        for name in ("postings", "terms", "lengths", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "lengths", "stats")])


def by_key(blocks: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, text) with the rows of a key in one partition, so that its tokens are counted where they are and none is sent. Texts are smaller than their postings.

    A task counts its tokens in some hundred times its part's bytes in storage, so that small parts keep it from spilling.
    """
    return parse.spread(blocks.select(key, text), key, size=2 << 20)


def exploded(blocks: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, term) for each token that the index keeps."""
    return blocks.select(key, F.explode(X.tokens(text)).alias("term")).filter(X.index_token(F.col("term")))


def postings(blocks: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    return exploded(by_key(blocks, key, text), key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def block_lengths(blocks: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, dl): how many tokens the index keeps, counted row by row; keys without any have no row."""
    kept = F.filter(X.tokens(text), X.index_token)
    return blocks.select(F.col(key).alias("key"), F.size(kept).cast("long").alias("dl")).groupBy("key").agg(F.sum("dl").alias("dl")).filter("dl > 0")


def build(blocks: DataFrame, key: str = "key", text: str = "text") -> Index:
    p = postings(blocks, key, text).withColumnRenamed(key, "key")
    lengths = block_lengths(blocks, key, text)
    return Index(p, p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def add(index: Index, blocks: DataFrame) -> Index:
    """Index with blocks in place of those with their keys: statistics follow from the postings."""
    fresh = build(blocks)
    return of_postings(index.postings.join(blocks.select("key").distinct(), "key", "left_anti").unionByName(fresh.postings))


def remove(index: Index, keys: DataFrame) -> Index:
    return of_postings(index.postings.join(keys.select("key").distinct(), "key", "left_anti"))


def of_postings(p: DataFrame) -> Index:
    lengths = p.groupBy("key").agg(F.sum("tf").alias("dl"))
    return Index(p, p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query with their multiplicity; a repeated word counts as often."""
    found = re.findall(X.TOKEN, query.lower())
    return dict(Counter(t for t in found if len(t) > 1 and t not in X.STOPWORDS))


def idf(n: Column, df: Column) -> Column:
    without = n - df
    return F.log1p((without + 0.5) / (0.5 + df))


def _part(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(blocks: DataFrame, query: str, key: str = "key", text: str = "text", where: Column | None = None, top_k: int | None = 10, digits: int | None = None) -> DataFrame:
    """(key, score) by score, of so many digits if any are given, ties by key. One scan; per key the query's terms are counted, so nothing is joined but one row of statistics."""
    terms = query_terms(query)
    names = [f"_t{k}" for k in range(len(terms))]
    if not terms:
        return blocks.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    counted = exploded(blocks, key, text).groupBy(key).agg(F.count("*").alias("dl"), *[F.count(F.when(F.col("term") == t, 1)).alias(x) for t, x in zip(terms, names)])
    stats = counted.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avgdl"), *[F.count(F.when(F.col(x) > 0, 1)).alias(f"{x}_df") for x in names])
    score = sum((F.lit(float(m)) * idf(F.col("_n"), F.col(f"{x}_df")) * _part(F.col(x), F.col("dl"), F.col("_avgdl")) for x, m in zip(names, terms.values())), F.lit(0.0))
    scored = counted.filter(sum((F.col(x) for x in names[1:]), F.col(names[0])) > 0).crossJoin(F.broadcast(stats)).select(key, (score if digits is None else F.round(score, digits)).alias("score"))
    if where is not None:
        scored = scored.join(blocks.filter(where).select(key), key, "left_semi")
    return scored.orderBy(F.desc("score"), key).limit(top_k) if top_k else scored


def bm25_indexed(index: Index, query: str, top_k: int = 10, digits: int | None = None) -> DataFrame:
    """The same scores from index tables: only postings of the query's terms are read.

    A key's parts are added in the query's order, so that equal blocks have equal scores and their ties are left to the key.
    """
    terms = query_terms(query)
    spark = index.postings.sparkSession
    q = F.broadcast(spark.createDataFrame([(t, m, k) for k, (t, m) in enumerate(terms.items())] or [("", 0, 0)], "term string, m int, k int"))
    hits = index.postings.join(q, "term").join(index.terms.join(q.select("term"), "term", "left_semi").select("term", "df"), "term").join(index.lengths, "key").crossJoin(F.broadcast(index.stats))
    part = F.col("m").cast("double") * idf(F.col("n"), F.col("df")) * _part(F.col("tf"), F.col("dl"), F.col("avgdl"))
    found = hits.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, part)), F.lit(0.0)).alias(f"_p{k}") for k in range(max(1, len(terms)))])
    score = sum((F.col(f"_p{k}") for k in range(1, len(terms))), F.lit(0.0) + F.col("_p0"))
    return found.select("key", (score if digits is None else F.round(score, digits)).alias("score")).orderBy(F.desc("score"), "key").limit(top_k)


def keywords(blocks: DataFrame, n: int = 10, key: str = "key", text: str = "text") -> DataFrame:
    """(key, rank, term, tf): the n most frequent tokens of each block, ties by first place."""
    pos = by_key(blocks, key, text).select(key, F.posexplode(X.tokens(text)).alias("pos", "term")).filter(X.index_token(F.col("term")))
    counted = pos.groupBy(key, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("tf"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(key, "rank", "term", "tf")


def tfidf_vocabulary(docs: DataFrame, key: str = "key", text: str = "text", max_features: int = 500, min_df: int = 1) -> DataFrame:
    """(term, df, idf, ix): the most common terms; idf = ln(n / (1 + df)), which may be 0 or less."""
    terms = docs.select(key, F.explode(F.array_distinct(X.tokens(text))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    top = terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(max_features)
    w = Window.orderBy(F.desc("df"), "term")  # over at most max_features rows
    return top.crossJoin(F.broadcast(n)).select("term", "df", F.ln(F.col("n") / (1 + F.col("df"))).alias("idf"), (F.row_number().over(w) - 1).alias("ix"))


def tfidf_embed(docs: DataFrame, vocabulary: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, ix, w): sparse unit vectors; a zero vector has no rows. The vocabulary is at most max_features rows."""
    tf = docs.select(key, F.explode(X.tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = tf.join(F.broadcast(vocabulary), "term").select(key, "ix", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("norm", norm).filter("norm > 0").select(key, "ix", (F.col("raw") / F.col("norm")).alias("w"))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def dense(vectors: DataFrame, query: DataFrame, key: str = "key", vector: str = "embedding", top_k: int | None = 10) -> DataFrame:
    """(key, score): cosine to the one row of `query` (column q), positive ones."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).select(key, cosine(F.col(vector), F.col("q")).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(top_k) if top_k else scored


def hybrid(bm25_hits: DataFrame, dense_hits: DataFrame, top_k: int = 10, weight: float = 0.5, key: str = "key", need_bm25: bool = True) -> DataFrame:
    """Both lists (of at most max(3 k, 50) rows each), each divided by its own maximum; nothing if BM25 found nothing, unless need_bm25 is off."""
    cut = lambda d: d.orderBy(F.desc("score"), key).limit(max(3 * top_k, 50))
    a, b = cut(bm25_hits), cut(dense_hits)
    share = lambda d, name: d.select(key, (F.col("score") / F.max("score").over(Window.partitionBy(F.lit(1)))).alias(name))  # noqa: E731  (a bounded list)
    both = share(a, "_a").join(share(b, "_b"), key, "full_outer")
    if need_bm25:
        both = both.join(F.broadcast(a.agg((F.count("*") > 0).alias("_any"))), F.col("_any"))
    out = both.select(key, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(top_k)


def block_filter(block_types: list[str] | None = None, min_importance: float | None = None, doc_id: str | None = None, site_id: str | None = None) -> Column:
    out = F.lit(True)
    if block_types:
        out &= F.col("type").isin(*block_types)
    if min_importance is not None:
        out &= F.col("importance") >= min_importance
    if doc_id is not None:
        out &= F.col("doc_id") == doc_id
    if site_id is not None:
        out &= F.col("site_id") == site_id
    return out
