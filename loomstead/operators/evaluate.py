"""Measures of compiled documents and of searches against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions import text as X


def token_efficiency(raw: Column, compiled: Column) -> Column:
    """(raw_tokens, compiled_tokens, compression): compression is null where nothing was compiled."""
    a, b = X.tokens_by_words(raw), X.tokens_by_words(compiled)
    return F.struct(a.cast("long").alias("raw_tokens"), b.cast("long").alias("compiled_tokens"), F.round(a / F.nullif(b, F.lit(0)), 2).alias("compression"))


def fidelity(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id with heading_fidelity, table_fidelity, code_fidelity, text_coverage, structure_score.

    expected: doc_id, headings array<string>, tables int, codes int, phrases array<string>. Headings and phrases count where they occur inside one.
    """
    kind = F.col("type")
    per = blocks.groupBy("doc_id").agg(
        F.collect_list(F.when(kind == "heading", F.lower(F.trim("text")))).alias("_h"), F.count_if(kind == "table").alias("_tables"), F.count_if(kind == "code").alias("_codes"), F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")).alias("_all")
    )
    both = expected.join(per, "doc_id", "left").withColumn("_h", F.coalesce("_h", F.array().cast("array<string>"))).withColumn("_all", F.coalesce("_all", F.lit("")))
    share = lambda some, ok: F.when(F.coalesce(F.size(some), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(some, ok)) / F.size(some))
    ratio = lambda have, want: F.when(F.coalesce(F.col(want), F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col(have), F.lit(0)) / F.col(want)))
    out = both.select(
        "doc_id", share(F.col("headings"), lambda e: F.exists("_h", lambda h: h.contains(F.lower(e)))).alias("heading_fidelity"), ratio("_tables", "tables").alias("table_fidelity"), ratio("_codes", "codes").alias("code_fidelity"),
        share(F.col("phrases"), lambda p: F.col("_all").contains(F.lower(p))).alias("text_coverage"),
    )
    return out.withColumn("structure_score", (F.col("heading_fidelity") + F.col("table_fidelity") + F.col("code_fidelity")) / 3)


def search_quality(results: DataFrame, items: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id with recall_<k> (1 if one of the k first is relevant) and reciprocal_rank. results: query_id, rank (from 1), text; items: query_id, keywords array<string>.

    A result is relevant if its text holds all keywords. Queries without results count 0.
    """
    both = results.join(items, "query_id").filter(F.forall("keywords", lambda w: F.lower("text").contains(F.lower(w))))
    first = both.groupBy("query_id").agg(F.min("rank").alias("_rank"))
    r = F.col("_rank")
    return items.join(first, "query_id", "left").select("query_id", *[F.when(r <= k, 1.0).otherwise(0.0).alias(f"recall_{k}") for k in at], F.coalesce(1.0 / r, F.lit(0.0)).alias("reciprocal_rank"))


def precision_recall(found: DataFrame, expected: DataFrame, keys: list[str], by: str = "doc_id") -> DataFrame:
    """(by, precision, recall, f1) of rows matched one to one on keys: of equal rows as many match as both sides have."""
    side = lambda d, name: d.select(by, *keys).groupBy(by, *keys).agg(F.count("*").alias(name))
    both = side(found, "_f").join(side(expected, "_e"), [by, *keys], "full_outer").fillna(0, ["_f", "_e"])
    per = both.groupBy(by).agg(F.sum(F.least("_f", "_e")).alias("_hit"), F.sum("_f").alias("_found"), F.sum("_e").alias("_expected"))
    p, r = F.coalesce(F.col("_hit") / F.nullif("_found", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("_hit") / F.nullif("_expected", F.lit(0)), F.lit(0.0))
    return per.select(by, p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))
