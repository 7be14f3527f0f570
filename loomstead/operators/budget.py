"""Markdown, summaries and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X

_META = "headers array<string>, rows array<array<string>>, items array<string>, ordered boolean, language string, src string, alt string"


def block_markdown() -> Column:
    """Markdown of one block from type, text, level and meta."""
    m = F.from_json("meta", _META)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(m["headers"], lambda x: F.lit("---")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.when(F.size(m["headers"]) > 0, F.array(line(m["headers"]), rule)).otherwise(F.array().cast("array<string>")), F.transform(m["rows"], line)), "\n")
    items = F.array_join(F.transform(m["items"], lambda x, k: F.concat(F.when(F.coalesce(m["ordered"], F.lit(False)), F.concat((k + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    t, k = F.col("text"), F.col("type")
    return (
        F.when(k == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(F.col("level"), F.lit(1))), F.lit(" "), t)).when(k == "table", F.coalesce(table, t)).when(k == "list", F.coalesce(items, t))
        .when(k == "code", F.concat(F.lit("```"), F.coalesce(m["language"], F.lit("")), F.lit("\n"), t, F.lit("\n```"))).when(k == "quote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> "))))
        .when(k == "image", F.concat(F.lit("!["), F.coalesce(m["alt"], F.lit("")), F.lit("]("), F.coalesce(m["src"], F.lit("")), F.lit(")"))).otherwise(t)
    )


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown)."""
    parts = F.array_sort(F.collect_list(F.struct("ord", block_markdown().alias("md"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n").alias("markdown"))


def summary(blocks: DataFrame, n: int = 10) -> DataFrame:
    """The n most important blocks of each document, in document order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("importance"), "ord")
    return blocks.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def doc_summary(blocks: DataFrame) -> DataFrame:
    """First two headings and the first paragraph (200 characters), in document order."""
    w = Window.partitionBy("doc_id", "type").orderBy("ord")
    k = blocks.filter(F.col("type").isin("heading", "paragraph")).withColumn("_r", F.row_number().over(w))
    kept = k.filter(((F.col("type") == "heading") & (F.col("_r") <= 2)) | ((F.col("type") == "paragraph") & (F.col("_r") == 1)))
    piece = F.when(F.col("type") == "paragraph", F.substring("text", 1, 200)).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("ord", piece.alias("t"))))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("summary"))


def prefix_within(rows: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows up to the first that would exceed the budget; none after it, small as it may be."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


# --- progressive compression: level by level until the document fits

def _level_texts() -> list[Column]:
    t, k = F.col("text"), F.col("type")
    lines = F.split(t, "\n")
    cut = lambda n, more: F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit(more))).otherwise(t)
    one = F.when((k == "paragraph") & (F.length(t) > 300), F.array_join(F.slice(X.sentences(t), 1, 2), " ")).otherwise(t)
    two = F.when(k == "table", cut(4, "\n...")).otherwise(one)
    three = F.when(k == "code", cut(5, "\n...")).otherwise(two)
    four = F.when(k == "list", cut(5, "\n...")).otherwise(three)
    return [t, one, two, three, four]


def compress(blocks: DataFrame, target_tokens: int) -> DataFrame:
    """Blocks within a budget of tokens (a quarter of the characters): doc_id, ord, type, text, level_used.

    Levels: 0 as is, 1 two sentences, 2 table rows, 3 code lines, 4 list items, 5 runs of unimportant blocks of one section become one line,
    6 the least important non-headings are dropped, down to one block. Each document stops at the first level that fits.
    """
    texts = _level_texts()
    doc = Window.partitionBy("doc_id")
    df = blocks.select("doc_id", "ord", "type", "importance", "section_path", *[x.alias(f"t{k}") for k, x in enumerate(texts)])
    est = lambda c: F.greatest(F.lit(1), F.floor(F.sum(F.length(c)).over(doc) / 4))
    for k in range(5):
        df = df.withColumn(f"e{k}", est(F.col(f"t{k}")))
    # Level 5: islands of low blocks with the same first section element.
    by = doc.orderBy("ord")
    low = (F.col("importance") < 0.3) & (F.col("type") != "heading")
    section = F.coalesce(F.get("section_path", F.lit(0)), F.lit(""))
    df = df.withColumn("low", low).withColumn("sec", section)
    start = ~F.coalesce(F.lag("low").over(by) & F.col("low") & (F.lag("sec").over(by) == F.col("sec")), F.lit(False))
    df = df.withColumn("island", F.sum(start.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("doc_id", "island")
    head = F.col("ord") == F.min("ord").over(w)
    many = F.count("*").over(w)
    df = df.withColumn("many", many).withColumn("head", head)
    t5 = F.when(~F.col("low"), F.col("t4")).when(F.col("head"), F.when(F.col("many") == 1, F.col("t4")).otherwise(F.concat(F.lit("["), F.col("many").cast("string"), F.lit(" blocks omitted]"))))
    df = df.withColumn("t5", t5)
    df = df.withColumn("e5", F.greatest(F.lit(1), F.floor(F.coalesce(F.sum(F.length("t5")).over(doc), F.lit(0)) / 4)))
    level = F.lit(6)
    for k in reversed(range(6)):
        level = F.when(F.col(f"e{k}") <= target_tokens, k).otherwise(level)
    df = df.withColumn("level_used", level)
    text = F.coalesce(*[F.when(F.col("level_used") == k, F.col(f"t{k}")) for k in range(6)], F.when(F.col("level_used") == 6, F.col("t5")))
    df = df.withColumn("text", text).filter(F.col("text").isNotNull())
    # Level 6: the j-th of the non-headings by (importance, ord) goes while what is left is too much and more than one block stays.
    heading = F.col("type") == "heading"
    order = Window.partitionBy("doc_id", heading).orderBy("importance", "ord")
    total, n = F.sum(F.length("text")).over(doc), F.count("*").over(doc)
    df = df.withColumn("_total", total).withColumn("_n", n).withColumn("_j", F.row_number().over(order)).withColumn("_before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dropped = (F.col("level_used") == 6) & ~heading & (F.greatest(F.lit(1), F.floor((F.col("_total") - F.col("_before")) / 4)) > target_tokens) & (F.col("_n") - (F.col("_j") - 1) > 1)
    return df.filter(~dropped).select("doc_id", "ord", "type", "text", "level_used")
