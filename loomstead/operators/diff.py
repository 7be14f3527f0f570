"""Document diffs and change feeds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def occurrences(df: DataFrame, keys: list[str], order: str, name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def exact_block_diff(old: DataFrame, new: DataFrame, doc: str = "doc_id", text: str = "text", order: str = "ord") -> DataFrame:
    """Blocks by (doc, text, occurrence): side is both, old or new; equal texts match one to one."""
    a = occurrences(old, [doc, text], order).select(doc, text, "nth", F.col(order).alias("old_ord"))
    b = occurrences(new, [doc, text], order).select(doc, text, "nth", F.col(order).alias("new_ord"))
    both = a.join(b, [doc, text, "nth"], "full_outer")
    side = F.when(F.col("old_ord").isNull(), "new").when(F.col("new_ord").isNull(), "old").otherwise("both")
    return both.withColumn("side", side)


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


def _greedy(doc_id: str, rows: list[dict], least: float) -> list[tuple]:
    """Each old block takes the first of the most similar new ones that are left, of `least` or more.

    What can't be similar enough by its length, or by the characters that both have, isn't compared; both are bounds of the ratio. A new
    block is prepared once for all that it is compared with.
    """
    old = sorted((r for r in rows if r["side"] == "old"), key=lambda r: r["old_ord"])
    new = sorted((r for r in rows if r["side"] == "new"), key=lambda r: r["new_ord"])
    texts = [n["text"] or "" for n in new]
    counts = [Counter(x) for x in texts] if old else []
    ready: list[SequenceMatcher | None] = [None] * len(new)
    left = list(range(len(new)))
    out = []
    for o in old:
        text = o["text"] or ""
        mine = Counter(text)
        best, at = least, None
        for k in left:
            both = max(1, len(text) + len(texts[k]))
            if 2 * min(len(text), len(texts[k])) / both < best or 2 * (mine & counts[k]).total() / both < best:
                continue
            m = ready[k]
            if m is None:
                m = ready[k] = SequenceMatcher(None, "", texts[k])
            m.set_seq1(text)
            s = m.ratio()
            if s >= best and (at is None or s > best):
                best, at = s, k
        if at is None:
            out.append((doc_id, "removed", o["text"], None, None))
        else:
            left.remove(at)
            out.append((doc_id, "modified", o["text"], new[at]["text"], best))
    return out + [(doc_id, "added", None, new[k]["text"], None) for k in left]


def block_changes(old: DataFrame, new: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, change (added, removed, modified), old_text, new_text, similarity: exact matches first, then greedy fuzzy ones per document.

    Only blocks without an exact match reach Python, a document in a row: a call for each document would cost more than the comparison.
    """
    rest = exact_block_diff(old, new).filter("side <> 'both'").select("doc_id", "text", "side", "old_ord", "new_ord")
    schema = "doc_id string, change string, old_text string, new_text string, similarity double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [x for d, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in _greedy(d, b, least)]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in rows], schema=arrow)

    return rest.groupBy("doc_id").agg(F.collect_list(F.struct("text", "side", "old_ord", "new_ord")).alias("b")).mapInArrow(run, schema)


def action_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Actions by selector or label: added, removed, or modified in type, role or label."""
    key = F.coalesce(F.nullif(F.col("selector"), F.lit("")), F.col("label"))
    side = lambda d, p: occurrences(d.withColumn("key", key), ["doc_id", "key"], "ord").select("doc_id", "key", "nth", F.struct("type", "role", "label").alias(p))
    both = side(old, "o").join(side(new, "n"), ["doc_id", "key", "nth"], "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select("doc_id", "key", "nth", "change")


def delta_feed(old_docs: DataFrame, new_docs: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """url, change: added, removed or updated pages, a row for each pair of an old and a new one at a URL.

    Updated where `changed` (doc_id of the new side) has rows; without it, where the pair's own `h`, a hash of the content, differs.
    """
    a = old_docs.select("url", F.lit(True).alias("was"), *([] if changed is not None else [F.col("h").alias("_old")]))
    b = new_docs.select("url", F.lit(True).alias("now"), *(["doc_id"] if changed is not None else [F.col("h").alias("_new")]))
    both = a.join(b, "url", "full_outer")
    if changed is not None:
        both = both.join(changed.select("doc_id", F.lit(True).alias("differs")).distinct(), "doc_id", "left")
    differs = F.col("differs") if changed is not None else F.col("_old") != F.col("_new")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(differs, "updated")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select("url", "change")
