"""Plans, re-ranking, answers, evidence and citations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X

from . import index as ix


@dataclass
class Step:
    tool: str
    args: dict = field(default_factory=dict)


@dataclass
class Plan:
    query: str
    intent: str
    steps: list[Step]
    stop: str
    confidence: float


_STEPS = {
    "fact": [("search_blocks", {})], "evidence": [("search_blocks", {"min_importance": 0.7})], "navigation": [("search_actions", {"type": "navigate"})],
    "task": [("search_actions", {}), ("search_blocks", {}), ("execute_action", {})], "hybrid": [("search_blocks", {}), ("search_actions", {})],
}


def plan(spark, query: str) -> Plan:
    """The plan of one query; the rules are the column expressions that also classify whole tables."""
    q = F.lit(query)
    r = spark.range(1).select(X.intent(q).alias("i"), X.intent_confidence(q).alias("c"), X.stop_condition(X.intent(q)).alias("s")).first()
    return Plan(query, r["i"], [Step(t, dict(a)) for t, a in _STEPS[r["i"]]], r["s"], r["c"])


_DATA = frozenset("data table price cost spec comparison feature plan".split())
_CODE = frozenset("api code endpoint function method sdk example snippet".split())


def rerank(hits: DataFrame, query: str, intent: str = "fact") -> DataFrame:
    """Adjusts score by type, section, importance and evidence; floor 0. Query words match as substrings of the section text."""
    words = sorted(set(query.lower().split()))
    section = F.lower(F.array_join("section_path", " "))
    matches = sum((F.when(section.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    gain = F.lit(0.0)
    if _DATA & set(words):
        gain = gain + F.when(F.col("type").isin("table", "product_spec", "faq"), 0.15).otherwise(0.0)
    if _CODE & set(words):
        gain = gain + F.when(F.col("type") == "code", 0.15).otherwise(0.0)
    gain = gain + 0.15 * F.least(matches, F.lit(3)) + F.when(F.col("importance") > 0.7, 0.15 * (F.col("importance") - 0.5)).otherwise(0.0)
    if intent == "evidence":
        gain = gain + F.when(F.col("evidence_score") > 0.7, 0.2 * (F.col("evidence_score") - 0.5)).otherwise(0.0)
    gain = gain - F.when(F.size("section_path") == 0, 0.05).otherwise(0.0)
    return hits.withColumn("score", F.greatest(F.lit(0.0), F.col("score") + gain))


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order that tells rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def search(blocks: DataFrame, query: str, top_k: int = 10, intent: str = "fact", where: Column | None = None) -> DataFrame:
    """Re-ranked blocks: BM25 over 3 k candidates, adjusted, one per (doc_id, block_id), cut to k."""
    keyed = blocks.withColumn("key", F.concat_ws(":", "doc_id", "block_id"))
    hits = ix.bm25(keyed, query, where=where, top_k=3 * top_k).join(keyed, "key")
    ranked = first_of(rerank(hits, query, intent), ["doc_id", "block_id"], F.desc("score"), "key")
    return ranked.orderBy(F.desc("score"), "key").limit(top_k)


def first_sentence(text: Column) -> Column:
    """The first sentence of 10 characters or more, else the text."""
    s = F.filter(X.sentences(text), lambda x: F.length(F.trim(x)) >= 10)
    return F.coalesce(F.get(s, F.lit(0)), text)


def answer(hits: DataFrame, intent: str, min_score: float = 0.3) -> DataFrame:
    """One row: answer, confidence, citations. hits: at most k rows."""
    kept = hits.filter(F.col("score") > min_score)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "text", "section_path")))
    top = F.get("rows", F.lit(0))
    if intent == "evidence":
        snippets = F.transform(F.slice("rows", 1, 5), lambda r, k: F.concat((k + 1).cast("string"), F.lit(". "), X.truncate(r["text"], 150)))
        text = F.array_join(snippets, "\n")
    else:
        text = first_sentence(top["text"])
    fallback = F.lit("No content found that answers the question.")
    return kept.agg(rows.alias("rows")).select(
        F.when(F.size("rows") == 0, fallback).otherwise(text).alias("answer"),
        F.when(F.size("rows") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), -top["s"]), 2)).alias("confidence"),
        F.transform("rows", lambda r: r["key"]).alias("citations"),
    )


# --- citations

def citation_tokens(text: Column) -> Column:
    """Distinct words of more than 2 characters before punctuation is stripped."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: F.length(w) > 0))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def relevance(answer_text: Column, evidence_text: Column) -> Column:
    a, e = citation_tokens(answer_text), citation_tokens(evidence_text)
    low = F.lower(answer_text)
    held = F.size(F.filter(e, lambda w: (F.length(w) > 3) & low.contains(w)))
    return F.when((F.size(a) == 0) | (F.size(e) == 0), 0.0).otherwise(0.6 * jaccard(a, e) + 0.4 * held / F.size(e))


def cite(answers: DataFrame, evidence: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """answers (keys, answer) with their evidence (keys, idx, text, confidence): the best, ranked, confidence scaled by relevance."""
    both = answers.join(evidence, keys).withColumn("relevance", relevance(F.col("answer"), F.col("text"))).filter("relevance > 0")
    w = Window.partitionBy(*keys).orderBy(F.desc("relevance"), "idx")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).withColumn("confidence", F.col("confidence") * F.least(F.lit(1.0), F.col("relevance")))


def answer_span(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The sentence of `answer` nearest to `text`; the first of equals, the first of all if none overlaps."""
    s = answers.select(*keys, "text", F.posexplode(X.sentences(F.col("answer"))).alias("pos", "sentence"))
    s = s.withColumn("overlap", jaccard(citation_tokens(F.col("sentence")), citation_tokens(F.col("text"))))
    return first_of(s, keys, F.desc("overlap"), "pos").select(*keys, "pos", "sentence", "overlap")


def evidence_id(url: Column, doc_id: Column, block_id: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), doc_id, block_id), 256), 1, 12))


def evidence(blocks: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Evidence rows of blocks (with url) and actions."""
    kind = F.when(F.col("type") == "table", "table_cell").when(F.col("type") == "code", "code_block").otherwise("web_block")
    out = blocks.select(evidence_id(F.col("url"), F.col("doc_id"), F.col("block_id")).alias("evidence_id"), kind.alias("kind"), "doc_id", F.col("block_id").alias("ref"), "url", "text", "section_path", F.col("importance").alias("confidence"))
    if actions is not None:
        out = out.unionByName(actions.select(evidence_id(F.col("url"), F.col("doc_id"), F.col("action_id")).alias("evidence_id"), F.lit("action").alias("kind"), "doc_id", F.col("action_id").alias("ref"), "url", F.concat_ws(": ", "type", "label").alias("text"), F.array().cast("array<string>").alias("section_path"), "confidence"))
    return out


def render_citations(cited: DataFrame, keys: list[str]) -> DataFrame:
    """Answer with [n] marks and footnotes, one row per answer."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "text", "url")))
    marks = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("]"))), "")
    notes = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("]: "), X.truncate(r["text"], 120), F.lit(" — "), F.coalesce(r["url"], F.lit("")))), "\n")
    return cited.groupBy(*keys, "answer").agg(rows.alias("rows")).select(*keys, F.concat(F.col("answer"), F.lit(" "), marks, F.lit("\n\n"), notes).alias("rendered"))


# --- tasks

_TASK_ORDER = (("login", r"(?i)\b(log\s*in|login|sign\s*in|signin)\b"), ("search", r"(?i)\b(search|find|look\s+up)\b"), ("download", r"(?i)\bdownload\b"), ("fill", r"(?i)\b(fill|submit|register|sign\s*up)\b"), ("navigate", r"(?i)\b(go\s+to|navigate|open|visit)\b"))
_TASK_STEPS = {"login": ["navigate", "fill:username", "fill:password", "submit"], "search": ["fill:query", "submit", "read"], "download": ["find", "download"], "fill": ["fill", "submit"], "navigate": ["navigate"], "actions": ["click"]}


def task_kind(task: Column) -> Column:
    out = F
    for name, pattern in _TASK_ORDER:
        out = out.when(task.rlike(pattern), name)
    return out.otherwise("actions")


def task_steps(tasks: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, pattern, needs_auth, step, command): the steps of each task text."""
    kind = task_kind(F.col(text))
    steps = F.coalesce(*[F.when(F.col("pattern") == k, F.array(*map(F.lit, v))) for k, v in _TASK_STEPS.items()])
    base = tasks.select(key, kind.alias("pattern"))
    out = base.select(key, "pattern", (F.col("pattern") == "login").alias("needs_auth"), F.posexplode(steps).alias("step", "command"))
    return out.withColumn("step", F.col("step") + 1)


def browser_command(kind: Column) -> Column:
    return F.when(kind.isin("click", "submit", "toggle", "download"), "click").when(kind == "input", "fill").otherwise(kind)


def action_relevance(task: str) -> Column:
    """0.3 per word of the label, 0.5 per task word inside the role, and 0.1 of the priority."""
    words = sorted(set(task.lower().split()))
    label = F.split(F.lower(F.col("label")), r"\s+")
    hits = F.size(F.array_intersect(F.array_distinct(label), F.array(*map(F.lit, words))))
    role = sum((F.when(F.lower(F.coalesce(F.col("role"), F.lit(""))).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return 0.3 * hits + 0.5 * role + 0.1 * F.col("priority")
