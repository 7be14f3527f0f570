"""Pages to rows: one pass over the HTML of a batch, then columns. Each function returns a DataFrame keyed by doc_id."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from loomstead.functions import dom

BLOCKS = "doc_id string, block_id string, ord int, type string, text string, level int, importance double, section_path array<string>, dom_path string, meta string"
ACTIONS = "doc_id string, action_id string, ord int, type string, label string, selector string, role string, confidence double, priority double, grp string, may_navigate boolean, may_download boolean, may_open_modal boolean, target_url string, required_fields array<string>, value_schema map<string,string>"
ASSETS = "doc_id string, asset_id string, ord int, type string, url string, alt string"
CHILDREN = "doc_id string, ord int, tag string, classes string, key string, text string"


def _flat_map(df: DataFrame, fn: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """fn(doc_id, html) gives the rows of one page; pages travel in Arrow batches. A null page gives none."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [r for d, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if h is not None for r in fn(d, h)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select("doc_id", "html").mapInArrow(run, schema)


def _block_rows(doc_id: str, root: dom.Node, clean: bool = True, profile: tuple[str, ...] = ()) -> list[dict]:
    found = dom.blocks(dom.normalize(root, profile) if clean else root)
    return [{**{k: b[k] for k in ("ord", "type", "text", "level", "importance", "section_path", "dom_path")}, "doc_id": doc_id, "block_id": f"b_{b['ord']:03d}", "meta": json.dumps(b["meta"], ensure_ascii=False)} for b in found]


def _action_rows(doc_id: str, root: dom.Node) -> list[dict]:
    return [{**{k: v for k, v in a.items() if k not in ("id", "group", "value_schema")}, "doc_id": doc_id, "action_id": a["id"], "grp": a["group"], "value_schema": list(a["value_schema"].items())} for a in dom.actions(root)]


def _asset_rows(doc_id: str, root: dom.Node) -> list[dict]:
    return [{**a, "doc_id": doc_id, "asset_id": f"asset_{a['ord']:03d}"} for a in dom.assets(root)]


def _child_rows(doc_id: str, root: dom.Node) -> list[dict]:
    return [{**c, "doc_id": doc_id} for c in dom.body_children(root)]


#: What `once` reads off a page, in an order in which no reader changes the tree for the next: blocks are cut from it last.
_KINDS = {"children": (_child_rows, CHILDREN), "assets": (_asset_rows, ASSETS), "actions": (_action_rows, ACTIONS), "blocks": (_block_rows, BLOCKS)}


def spread(df: DataFrame, *keys: str, size: int = 64 << 20) -> DataFrame:
    """df in partitions for work that is heavy for its bytes: one for each core at least, of about `size` bytes, 64 MB, by the planner's estimate, and not merged again.

    Where the planner has no estimate (it then says exabytes), as many as shuffles have.
    """
    whole = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = df.sparkSession
    known = -(-whole // size) if whole < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, known), *keys)


def once(pages: DataFrame, kinds: tuple[str, ...] = ("actions", "blocks")) -> DataFrame:
    """pages (doc_id, html) with a column for each kind, parsed in one pass and kept while it is in use: `blocks`, `actions`, `assets` and `body_children` then read these.

    Kept rows are recomputed where an executor is lost; they lie on disk where memory is short.
    """
    names = [k for k in _KINDS if k in kinds]
    schema = "doc_id string, " + ", ".join(f"_{k} array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in _KINDS[k][1].split(', '))}>>" for k in names)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for d, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    root = dom.parse(h) if h is not None else None
                    rows.append({"doc_id": d, **{f"_{k}": _KINDS[k][0](d, root) if root is not None else [] for k in names}})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select("doc_id", "html").mapInArrow(run, schema).persist(StorageLevel.MEMORY_AND_DISK)


def _read(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.select(F.inline(f"_{kind}"))


def blocks(pages: DataFrame, clean: bool = True, profile: tuple[str, ...] = ()) -> DataFrame:
    """Typed blocks of (doc_id, html), or of what `once` gave. clean: drop boilerplate and noise first."""
    if "_blocks" in pages.columns and clean and not profile:
        return _read(pages, "blocks")
    return _flat_map(pages, lambda d, h: _block_rows(d, dom.parse(h), clean, profile), BLOCKS)


def profiled_blocks(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Blocks of pages (doc_id, domain, html), the parts that the domain's learned profile (domain, key, kind) calls headers, footers, sidebars, noise or template left out.

    A page carries the keys of its domain, of which there are few, into the one pass that parses it.
    """
    parts = F.col("kind").isin("header", "footer", "sidebar", "noise", "template") & ~F.col("key").endswith("|")  # without a class a key is a mere tag
    keys = profiles.filter(parts).groupBy("domain").agg(F.sort_array(F.collect_set(F.replace("key", F.lit("|"), F.lit(".")))).alias("_keys"))
    both = pages.select("doc_id", "domain", "html").join(keys, "domain", "left").select("doc_id", "html", F.coalesce("_keys", F.array().cast("array<string>")).alias("_keys"))
    arrow = to_arrow_schema(_parse_datatype_string(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [r for d, h, k in zip(*(c.to_pylist() for c in part.columns)) if h is not None for r in _block_rows(d, dom.parse(h), True, tuple(k))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return both.mapInArrow(run, BLOCKS)


def actions(pages: DataFrame) -> DataFrame:
    return _read(pages, "actions") if "_actions" in pages.columns else _flat_map(pages, lambda d, h: _action_rows(d, dom.parse(h)), ACTIONS)


def assets(pages: DataFrame) -> DataFrame:
    return _read(pages, "assets") if "_assets" in pages.columns else _flat_map(pages, lambda d, h: _asset_rows(d, dom.parse(h)), ASSETS)


def body_children(pages: DataFrame) -> DataFrame:
    return _read(pages, "children") if "_children" in pages.columns else _flat_map(pages, lambda d, h: _child_rows(d, dom.parse(h)), CHILDREN)


def section_paths(blocks_: DataFrame) -> DataFrame:
    """The section path again, relationally: for each level the last heading, unless a higher one came after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("ord", "text")), ignorenulls=True).over(w) for k in range(1, 7)]
    df = blocks_.select("*", *[x.alias(f"_h{k}") for k, x in enumerate(last, 1)])
    parts = []
    for k in range(1, 7):
        own = F.col(f"_h{k}")
        over = F.lit(-1) if k == 1 else F.greatest(*[F.coalesce(F.col(f"_h{j}.ord"), F.lit(-1)) for j in range(1, k)], F.lit(-1))
        parts.append(F.when(own["ord"] > over, own["text"]))
    return df.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"_h{k}" for k in range(1, 7)])
