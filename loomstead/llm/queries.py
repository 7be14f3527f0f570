"""The registered queries of this subpackage: one per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstead import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file; the files stay where they are installed."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), modulus=100, k=10)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.sp_codec import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep_ids=False)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.ngram_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.warc import audit_report

    return audit_report(_table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.shard import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.pack import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.quality import assess

    return assess(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstead.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ann_graph, op2_license_scan, op3_sentencepiece, op4_jaccard_join, op5_warc_audit, op6_lm_score, op7_vector_shards, op8_bestfit_pack, op9_quality_rules, op10_language_id)
}

_WARC_SQL = """
WITH base AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
n AS (SELECT greatest(1, ceil(count(*) / 1024.0))::BIGINT AS archives FROM pages),
recs AS (
  SELECT page_id, sha256(record) AS digest, strlen(record)::BIGINT AS length, count(*) AS copies
  FROM (SELECT page_id, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: response', 'WARC-Target-URI: ' || url, 'WARC-Payload-Digest: sha256:' || sha256(html),
    'Content-Type: text/html', 'Content-Length: ' || strlen(html), '', html, '', '') AS record FROM base)
  GROUP BY ALL),
placed AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', page_id::VARCHAR, digest)), 1, 8))::BIGINT) % (SELECT archives FROM n) AS archive FROM recs)
SELECT page_id, archive, row_number() OVER w - 1 AS seq,
  coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length, digest, copies, (('0x' || substr(digest, 1, 8))::BIGINT) % 500 <> 0 AS intact
FROM placed WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest)
"""

ORACLE_SQL: dict[str, str] = {"op5_warc_audit": _WARC_SQL}
