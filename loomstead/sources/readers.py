"""Sources: stored page tables, files by suffix, JSON documents, and routing between them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loomstead.functions import text as X

MIME = {"html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "xml": "application/xml", "json": "application/json"}
PAGINATION_KEYS = ("next", "next_url", "next_page", "nextPage", "next_link", "previous", "previous_url", "prev", "prev_page", "prev_link")
BLOCKS = "doc_id string, block_id string, ord int, type string, text string, level int, importance double, section_path array<string>, dom_path string, meta string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page table with doc_id, site_id, url and html."""
    return spark.read.parquet(path).select(X.doc_id("html").alias("doc_id"), X.site_id("url").alias("site_id"), "page_id", "url", "html")


def mime(path: F.Column) -> F.Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in MIME.items()], F.lit("application/octet-stream"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content_type, content (binary), text (for types that are text)."""
    f = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("content_type", mime(F.col("path")))
    return f.withColumn("text", F.when(~F.col("content_type").rlike("pdf|wordprocessing|octet"), F.decode("content", "UTF-8")))


def route(pages_: DataFrame) -> DataFrame:
    """kind: json, html, text or binary, and html made of plain text."""
    kind = F.when(X.looks_binary("html"), "binary").when(X.looks_json("html"), "json").when(X.looks_html("html"), "html").otherwise("text")
    return pages_.withColumn("kind", kind).withColumn("html", F.when(F.col("kind") == "text", X.plain_to_html("html")).otherwise(F.col("html")))


def walk_json(value: object) -> tuple[str, list[dict]]:
    """Title and blocks of a JSON value: keys become headings, scalars, lists and tables their blocks."""
    out: list[dict] = []

    def emit(kind: str, text: str, importance: float, path: list[str], level: int | None = None, meta: dict | None = None) -> None:
        out.append({"ord": len(out), "type": kind, "text": text, "importance": importance, "section_path": path, "level": level, "meta": meta or {}, "dom_path": "$." + ".".join(path)})

    def walk(v: object, depth: int, path: list[str]) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if k in PAGINATION_KEYS or x is None:
                    continue
                emit("heading", str(k), max(0.3, 0.8 - 0.1 * depth), [*path, str(k)], min(depth + 1, 6))
                walk(x, depth + 1, [*path, str(k)])
        elif isinstance(v, list):
            v = [x for x in v if x is not None]
            if v and all(isinstance(x, dict) for x in v):
                columns = list(dict.fromkeys(k for x in v for k in x))
                rows = [[json.dumps(x[k], ensure_ascii=False) if isinstance(x.get(k), (dict, list)) else "" if x.get(k) is None else str(x[k]) for k in columns] for x in v]
                emit("table", "\n".join(" | ".join(r) for r in [columns, *rows]), 0.6, path, meta={"headers": columns, "rows": rows})
            elif v and all(isinstance(x, str) for x in v):
                emit("list", "\n".join(v), 0.5, path, meta={"items": v})
            else:
                for x in v:
                    walk(x, depth, path)
        elif isinstance(v, bool) or isinstance(v, (int, float)):
            emit("metadata", str(v).lower() if isinstance(v, bool) else str(v), 0.3, path)
        elif isinstance(v, str) and v.strip():
            emit("paragraph", v, 0.5, path)

    walk(value, 0, [])
    title = next((str(value[k]) for k in "title name label heading".split() if isinstance(value, dict) and isinstance(value.get(k), str) and value[k]), "")
    return title, out


def json_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, json). Text that isn't JSON gives none."""
    arrow = to_arrow_schema(_parse_datatype_string(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = json.loads(t)
                except (TypeError, ValueError):
                    continue
                rows += [{**b, "doc_id": d, "block_id": f"b_{b['ord']:03d}", "meta": json.dumps(b["meta"], ensure_ascii=False)} for b in walk_json(value)[1]]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select("doc_id", "json").mapInArrow(run, BLOCKS)


def json_pagination(docs: DataFrame) -> DataFrame:
    """(doc_id, role, target_url) of paging links at the top of JSON documents."""
    one = lambda k: F.get_json_object("json", f"$.{k}")
    pairs = F.array(*[F.struct(F.lit("next_page" if k.startswith("next") else "prev_page").alias("role"), F.lit(k).alias("key"), one(k).alias("target_url")) for k in PAGINATION_KEYS])
    return docs.select("doc_id", F.explode(F.filter(pairs, lambda p: p["target_url"].isNotNull() & (F.length(p["target_url"]) > 0))).alias("p")).select("doc_id", "p.*")


#: name -> function (spark, target) -> DataFrame; network and browser sources are for deployments to register.
FETCHERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pages": pages, "files": files}


def resolve_fetcher(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in FETCHERS:
        raise KeyError(f"no source is registered as {name}; registered: {', '.join(sorted(FETCHERS))}")
    return FETCHERS[name]


def detect_encoding(header: str | None, content: bytes) -> str:
    """Charset of the header, else of a meta tag, else of a byte-order mark, else UTF-8."""
    import re

    if header and (m := re.search(r"charset=[\"']?([\w-]+)", header, re.I)):
        return m.group(1).lower()
    if m := re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", content[:2048], re.I):
        return m.group(1).decode().lower()
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return name
    return "utf-8"


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of PDF text spans (doc_id, page, ord, text, size, bold): headings by size against the document's median, or by bold.

    PDF and DOCX files themselves need parsers that aren't installed; this is the rule over spans that one would give.
    """
    body = spans.groupBy("doc_id").agg(F.percentile_approx("size", 0.5).alias("body"))
    df = spans.join(body, "doc_id")
    ratio = F.col("size") / F.col("body")
    level = F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.15, 3).when(F.col("bold") & (F.length("text") < 120), 4)
    return df.withColumn("level", level).withColumn("type", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph")).drop("body")
