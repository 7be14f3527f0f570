"""Query-aware filtering of a document's blocks, and retrieval by the steps of a plan."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X

from . import index as ix
from . import retrieve

#: Floor of importance where a plan asks for evidence.
EVIDENCE_FLOOR = 0.7


def query_filter(blocks: DataFrame, query: str, threshold: float = 0.1, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), blend: float = 0.5, max_blocks: int | None = None) -> DataFrame:
    """Blocks that matter for a query: relevance, importance blended with it, and rank within the document (doc_id).

    Relevance adds the squashed TF-IDF of the query's words in the text (idf = ln(1 + n / (1 + df)) over the document's blocks), the
    share of them in the section path, and 1 / (1 + d) for the nearest heading that holds one, d places away. Blocks under the threshold
    go; max_blocks keeps the best of each document. A query without words changes nothing. A document is a page: its blocks meet in one task.
    """
    if not query.strip():
        raise ValueError("the query is empty")
    words = re.findall(X.TOKEN, query.lower())
    if not words:
        return blocks
    terms = list(Counter(words).items())
    many = float(len(words))
    cut = blocks.withColumn("_t", X.tokens("text")).withColumn("_s", X.tokens(F.array_join("section_path", " ")))
    n = F.size("_t")
    count = lambda t: F.size(F.filter("_t", lambda x: x == t))
    df = cut.select("*", *[count(t).alias(f"_c{k}") for k, (t, _) in enumerate(terms)])
    names = [f"_c{k}" for k in range(len(terms))]
    any_word = F.greatest(*names, F.lit(0)) > 0
    each = df.groupBy("doc_id").agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) > 0).alias(f"{c}_df") for c in names])
    df = df.join(each, "doc_id").withColumn("_h", F.when((F.col("type") == "heading") & any_word, F.col("ord")))
    by = Window.partitionBy("doc_id").orderBy("ord")
    before = F.last("_h", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_h", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    away = F.least(F.col("ord") - before, after - F.col("ord"))
    raw = sum((m * F.col(c) / n * F.ln(1 + F.col("_n") / (1.0 + F.col(f"{c}_df"))) for c, (_, m) in zip(names, terms)), F.lit(0.0)) / many
    tfidf = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 2 / (1 + F.exp(-5 * raw)) - 1))
    section = sum((F.when(F.array_contains("_s", t), float(m)).otherwise(0.0) for t, m in terms), F.lit(0.0)) / many
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weights[0] * tfidf + weights[1] * section + weights[2] * F.coalesce(1 / (1.0 + away), F.lit(0.0))))
    scored = df.withColumn("relevance", relevance).filter(F.col("relevance") >= threshold)
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance") * (1 - blend) + F.col("relevance") * blend))
    ranked = scored.withColumn("importance", mixed).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("importance"), "ord")))
    out = ranked.select(*blocks.columns, "relevance", "rank")
    return out.filter(F.col("rank") <= max_blocks) if max_blocks else out


def by_plan(blocks: DataFrame, actions: DataFrame, query: str, top_k: int = 10, where: Column | None = None, plan: retrieve.Plan | None = None) -> DataFrame:
    """(kind, doc_id, id, text, score): every search step of the query's plan, 3 k candidates each, re-ranked, one row a block or action, the k best.

    Evidence steps take blocks of importance EVIDENCE_FLOOR or more. Only blocks are re-ranked. Steps that act are the caller's.
    """
    plan = plan or retrieve.plan(blocks.sparkSession, query)
    found: list[DataFrame] = []
    for step in plan.steps:
        if step.tool == "search_blocks":
            floor = step.args.get("min_importance")
            only = where if floor is None else (F.col("importance") >= floor if where is None else where & (F.col("importance") >= floor))
            keyed = blocks.withColumn("key", F.concat_ws(":", "doc_id", "block_id"))
            hits = ix.bm25(keyed, query, where=only, top_k=3 * top_k).join(keyed, "key")
            found.append(retrieve.rerank(hits, query, plan.intent).select(F.lit("block").alias("kind"), "doc_id", F.col("block_id").alias("id"), "text", "score"))
        elif step.tool == "search_actions":
            keyed = actions.withColumn("key", F.concat_ws(":", "doc_id", "action_id")).withColumn("_text", F.concat_ws(" ", "label", "role"))
            only = F.col("type") == step.args["type"] if "type" in step.args else None
            hits = ix.bm25(keyed, query, text="_text", where=only, top_k=3 * top_k).join(keyed, "key")
            found.append(hits.select(F.lit("action").alias("kind"), "doc_id", F.col("action_id").alias("id"), F.col("label").alias("text"), "score"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    one = retrieve.first_of(every, ["kind", "doc_id", "id"], F.desc("score"))
    return one.orderBy(F.desc("score"), "kind", "doc_id", "id").limit(top_k)
