"""Alignment of blocks and actions with their source: character ranges, boxes on a screenshot, nodes of an accessibility tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "role string, name string, value string, description string, bbox array<double>"


def char_range(text: Column, html: Column) -> Column:
    """(first, end) of text in html, else of its first 80 characters if these are 10 or more; null where neither occurs."""
    head = F.trim(F.substring(text, 1, 80))
    whole, part = F.position(text, html), F.position(head, html)
    span = lambda at, t: F.struct((at - 1).alias("first"), (at - 1 + F.length(t)).alias("end"))
    return F.when((F.length(text) == 0) | (F.length(html) == 0), None).when(whole > 0, span(whole, text)).when((F.length(head) >= 10) & (part > 0), span(part, head))


def char_ranges(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with char_range in the html of their page (doc_id, html)."""
    return blocks.join(pages.select("doc_id", "html"), "doc_id").withColumn("char_range", char_range(F.col("text"), F.col("html"))).drop("html")


def region_id(kind: str, ref: Column) -> Column:
    return F.concat(F.lit("r_"), F.substring(F.md5(F.concat(F.lit(f"{kind}_"), ref)), 1, 8))


def with_boxes(items: DataFrame, positions: DataFrame, kind: str, ref: str, selector: Column) -> DataFrame:
    """Items (blocks or actions) with region_id and box [left, top, right, bottom] where positions (doc_id, selector, bbox: x, y, width, height) has their selector."""
    p = positions.filter(F.size("bbox") == 4).select("doc_id", F.col("selector").alias("_selector"), "bbox").dropDuplicates(["doc_id", "_selector"])
    both = items.withColumn("_selector", selector).join(p, ["doc_id", "_selector"], "left")
    b = F.col("bbox")
    box = F.when(b.isNotNull(), F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))
    return both.withColumn("region_id", F.when(b.isNotNull(), region_id(kind, F.col(ref)))).withColumn("box", box).drop("bbox", "_selector")


def flatten_ax(trees: DataFrame, name: str = "tree") -> DataFrame:
    """(doc_id, ord, role, name, value, description, bbox): nodes of JSON trees in document order. Trees nest without a bound, so they are walked in Python, in Arrow batches."""
    import json

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"doc_id string, ord int, {NODES}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    todo = [json.loads(text)] if text else []
                except ValueError:
                    todo = []
                k = 0
                while todo:
                    node = todo.pop()
                    if isinstance(node, dict) and node:
                        box = node.get("bbox")
                        rows.append({"doc_id": doc, "ord": k, "role": str(node.get("role", "unknown")), "name": str(node.get("name", "")), "value": str(node.get("value", "")), "description": str(node.get("description", "")), "bbox": [float(x) for x in box] if box else None})
                        k += 1
                        todo += reversed(node.get("children") or [])
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return trees.select(F.col("doc_id").cast("string"), F.col(name).cast("string")).mapInArrow(run, schema)


def with_ax(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks with ax_role and ax_bbox of the node of their document that is named like their first 100 characters, else of the first whose name's first 50 start them.

    Both are joins on equality: a block offers its heads in the lengths that names of its document have. Of nodes of one name the last counts.
    """
    head = F.trim(F.lower(F.substring("text", 1, 100)))
    named = nodes.withColumn("name", F.trim(F.lower("name"))).filter("name <> ''")
    last = Window.partitionBy("doc_id", "name").orderBy(F.desc("ord"))
    first = F.min("ord").over(Window.partitionBy("doc_id", "name"))  # a name keeps the place where it came first
    named = named.withColumn("_first", first).withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("doc_id", "name", F.struct("_first", "role", "bbox").alias("node"))
    starts = named.select("doc_id", F.substring("name", 1, 50).alias("_start"), "node").groupBy("doc_id", "_start").agg(F.min_by("node", "node._first").alias("near"))
    sizes = starts.select("doc_id", F.length("_start").alias("_len")).distinct()
    b = blocks.withColumn("_head", head)
    offered = b.select("doc_id", "block_id", "_head").join(sizes, "doc_id").filter(F.length("_head") >= F.col("_len"))
    hits = offered.withColumn("_start", F.substring(F.col("_head"), F.lit(1), F.col("_len"))).join(starts, ["doc_id", "_start"]).groupBy("doc_id", "block_id").agg(F.min_by("near", "near._first").alias("near"))
    both = b.join(named.withColumnRenamed("name", "_head"), ["doc_id", "_head"], "left").join(hits, ["doc_id", "block_id"], "left")
    node = F.coalesce("node", "near")
    return both.withColumn("ax_role", node["role"]).withColumn("ax_bbox", node["bbox"]).drop("_head", "node", "near")
