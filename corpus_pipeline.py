"""Corpus pipeline over `documents`: language ID, quality rules, near duplicates, packing.

Each stage works on all that the one before kept. All but the last return the columns of `documents`; the last returns
the pieces of the packed sequences. A stage keeps rows whole and unchanged; which rows go:
language ID those of no language (null text, or no letter), quality rules those that fail the base rules or diverge from every
language, the join all but the smallest doc_id of each group of linked documents. Rows with a null doc_id are kept
unless a stage rejects their text; of rows that repeat a doc_id, the join keeps those of its group's smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead import ship
from loomstead.llm import common, langid, ngram_join, pack, quality
from loomstead.llm.queries import tokenizer_file


#: Ids of removed documents that are broadcast at most: 8 MB.
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.reject_unknown(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    joined = ngram_join.jaccard_join(docs)
    gone = common.save(joined.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "pipeline-copies")
    if gone.count() <= BROADCAST_IDS:  # else both sides are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]

#: The classifier, the references and the packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.save(docs, f"pipeline-{name}")
    return docs
