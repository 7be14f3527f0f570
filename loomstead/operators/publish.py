"""Published outputs of a site and renderings of documents for language models, one string per page or site.

Inputs: docs (doc_id, site_id, url, title), blocks and actions as parsed. Strings are built by aggregation, so each site or
document is one row; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X

from .retrieve import first_of


#: Characters of llms.txt; selectors of skills that are tested at once.
MAX_TEXT, MAX_HINTS = 8_000, 10_000


def _joined(rows: Column, sep: str = "\n") -> Column:
    """Strings t of structs (order..., t), in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), sep)


def cut_lines(text: Column, n: int = 8000) -> Column:
    """At most n characters, cut at the end of a line."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(head, r"\n[^\n]*$", ""))


def sections(docs: DataFrame) -> DataFrame:
    """Docs with section: the first path segment, title-cased, or Home."""
    first = F.regexp_extract(X.url_path("url"), "^/([^/]+)", 1)
    return docs.withColumn("section", F.when(first == "", "Home").otherwise(F.initcap(F.regexp_replace(first, "[-_]", " "))))


def llms_txt(docs: DataFrame, blocks: DataFrame, actions: DataFrame, limit: int | None = MAX_TEXT) -> DataFrame:
    """(site_id, llms_txt): pages by section, those with most blocks first, then the roles of actions. limit: characters, cut at a line; None: all."""
    n = blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    d = sections(docs).join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    line = F.concat(F.lit("- ["), F.coalesce("title", "url"), F.lit("]("), F.col("url"), F.lit("): "), F.col("n").cast("string"), F.lit(" blocks"))
    per = d.groupBy("site_id", "section").agg(_joined(F.struct((-F.col("n")).alias("o"), "url", line.alias("t"))).alias("lines"))
    body = per.groupBy("site_id").agg(_joined(F.struct("section", F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("lines")).alias("t")), "\n\n").alias("body"))
    roles = actions.join(docs.select("doc_id", "site_id"), "doc_id").filter("role is not null").groupBy("site_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("roles"))
    text = F.concat(F.lit("# "), F.col("site_id"), F.lit("\n\n"), F.col("body"), F.when(F.col("roles").isNotNull(), F.concat(F.lit("\n\n## Actions\n"), F.col("roles"))).otherwise(""))
    return body.join(roles, "site_id", "left").select("site_id", (cut_lines(text, limit) if limit else text).alias("llms_txt"))


def content_feed(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(site_id, content_json): blocks of importance 0.2 or more, 500 characters each."""
    b = blocks.filter("importance >= 0.2").select("doc_id", "ord", F.struct("type", X.truncate("text", 500).alias("text"), F.round("importance", 3).alias("importance"), "section_path").alias("b"))
    per = b.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "b"))), lambda x: x["b"]).alias("blocks"))
    pages = docs.join(per, "doc_id", "left").groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("url", "title", "blocks"))).alias("pages"))
    return pages.select("site_id", F.to_json(F.struct("site_id", "pages")).alias("content_json"))


def capability(kind: Column, role: Column) -> Column:
    r = F.coalesce(role, F.lit(""))
    return (
        F.when(r.contains("search"), "search").when(r.contains("login"), "authenticate").when(r.isin("next_page", "prev_page", "previous_page"), "paginate").when(kind == "download", "download")
        .when(kind == "submit", "submit_form").when(kind == "upload", "upload").when(kind == "navigate", "navigate").otherwise("interact")
    )


def actions_feed(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(site_id, capabilities, actions_json): actions once per role, selector and type."""
    a = actions.drop("url", "site_id").join(docs.select("doc_id", "site_id", "url"), "doc_id").withColumn("r", F.coalesce("role", F.lit("")))
    one = first_of(a, ["site_id", "r", "selector", "type"], "url", "ord")
    per = one.groupBy("site_id").agg(F.sort_array(F.collect_set(capability(F.col("type"), F.col("role")))).alias("capabilities"), F.array_sort(F.collect_list(F.struct("url", "ord", "type", "role", "label", "selector", "required_fields"))).alias("actions"))
    return per.select("site_id", "capabilities", F.to_json(F.struct("capabilities", "actions")).alias("actions_json"))


def sitemap(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(site_id, sitemap): pages with mean importance and block types by frequency."""
    kinds = blocks.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("ord").alias("o")).groupBy("doc_id").agg(_joined(F.struct((-F.col("n")).alias("k"), "o", F.col("type").alias("t")), ",").alias("types"))
    mean = blocks.groupBy("doc_id").agg(F.round(F.avg("importance"), 2).alias("imp"))
    d = docs.join(kinds, "doc_id", "left").join(mean, "doc_id", "left")
    esc = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("  <page><loc>"), esc, F.lit("</loc><importance>"), F.coalesce(F.col("imp").cast("string"), F.lit("0.0")), F.lit("</importance><content>"), F.coalesce("types", F.lit("")), F.lit("</content></page>"))
    return d.groupBy("site_id").agg(F.concat(F.lit("<agent-sitemap>\n"), _joined(F.struct("url", page.alias("t"))), F.lit("\n</agent-sitemap>")).alias("sitemap"))


def agent_json(docs: DataFrame, blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """(site_id, agent_json): per page counts of block types, topics and roles; per site all roles."""
    counts = blocks.groupBy("doc_id", "type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("block_counts"))
    topics = blocks.filter("type = 'heading'").groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), 1, 5).alias("topics"))
    roles = actions.filter("role is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    d = docs.join(counts, "doc_id", "left").join(topics, "doc_id", "left").join(roles, "doc_id", "left")
    per = d.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("url", "title", "topics", "roles", F.to_json("block_counts").alias("block_counts")))).alias("pages"))
    return per.select("site_id", F.to_json(F.struct("site_id", F.array_sort(F.array_distinct(F.flatten(F.transform("pages", lambda p: F.coalesce(p["roles"], F.array().cast("array<string>")))))).alias("roles"), "pages")).alias("agent_json"))


AGENT = "site_id string, roles array<string>, pages array<struct<url:string,title:string,topics:array<string>,roles:array<string>,block_counts:string>>"


def parse_agent_json(df: DataFrame, name: str = "agent_json") -> DataFrame:
    """Spec columns; a text that isn't an object with pages has a null spec."""
    spec = F.from_json(name, AGENT)
    return df.select("*", F.when(spec["pages"].isNotNull(), spec).alias("spec"))


def skill_markdown(docs: DataFrame, apis: DataFrame, actions: DataFrame) -> DataFrame:
    """(site_id, skill_md): endpoints (confidence 0.5 or more, first 8, secrets redacted) and stable selectors."""
    a = apis.filter("confidence >= 0.5").join(docs.select("doc_id", "site_id"), "doc_id").select("site_id", "method", X.redact("endpoint").alias("endpoint"), "confidence", "safety").distinct()
    w = Window.partitionBy("site_id").orderBy(F.desc("confidence"), "method", "endpoint")
    a = a.withColumn("_r", F.row_number().over(w)).filter("_r <= 8")
    lines = a.groupBy("site_id").agg(_joined(F.struct("_r", F.concat(F.lit("- `"), F.col("method"), F.lit(" "), F.col("endpoint"), F.lit("` ("), F.col("safety"), F.lit(")")).alias("t"))).alias("apis"))
    s = actions.filter("selector like '#%'").join(docs.select("doc_id", "site_id"), "doc_id").select("site_id", "selector", "label").groupBy("site_id", "selector").agg(F.min("label").alias("label"))
    sel = s.groupBy("site_id").agg(_joined(F.struct("selector", F.concat(F.lit("- `"), F.col("selector"), F.lit("`: "), F.col("label")).alias("t"))).alias("selectors"))
    sites = docs.select("site_id").distinct().join(lines, "site_id", "left").join(sel, "site_id", "left")
    return sites.select("site_id", F.concat(F.lit("# "), "site_id", F.lit("\n\n## APIs\n"), F.coalesce("apis", F.lit("none")), F.lit("\n\n## Selectors\n"), F.coalesce("selectors", F.lit("none"))).alias("skill_md"))


def parse_skill(df: DataFrame, name: str = "skill_md") -> DataFrame:
    """selectors and urls that a skill text holds in code marks."""
    marks = F.regexp_extract_all(name, F.lit("`([^`\n]+)`"), F.lit(1))
    return df.select("*", F.filter(marks, lambda x: x.rlike(r"^[#.\[]")).alias("selectors"), F.regexp_extract_all(name, F.lit(r"https?://[^\s`)]+"), F.lit(0)).alias("urls"))


def apply_hints(blocks: DataFrame, selectors: DataFrame) -> DataFrame:
    """Importance + 0.25 (1 at most) where all tokens of a selector occur in the DOM path. selectors: at most MAX_HINTS distinct rows, (selector)."""
    toks = F.filter(F.split("selector", r"[#.\s>\[\]=\"']+"), lambda t: F.length(t) > 0)
    rows = [r["toks"] for r in selectors.select(F.array_sort(toks).alias("toks")).filter(F.size("toks") > 0).distinct().limit(MAX_HINTS + 1).collect()]
    if len(rows) > MAX_HINTS:
        raise ValueError(f"more than {MAX_HINTS} selectors")
    # Paths are few, blocks many: each distinct path is tested once, against a list of bounded size.
    paths = blocks.select("dom_path").distinct().withColumn("hit", F.exists(F.lit([list(r) for r in rows]) if rows else F.array().cast("array<array<string>>"), lambda h: F.forall(h, lambda t: F.col("dom_path").contains(t))))
    hits = paths.filter("hit")
    return blocks.join(hits, "dom_path", "left").withColumn("importance", F.when(F.col("hit"), F.least(F.lit(1.0), F.col("importance") + 0.25)).otherwise(F.col("importance"))).select(*blocks.columns)


# --- renderings for language models

_ROLES = {"heading": "heading", "paragraph": "text", "table": "table", "code": "code", "list": "list", "quote": "blockquote", "image": "img", "faq": "group", "figure_caption": "caption"}


def xml_escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def format_blocks(blocks: DataFrame, style: str) -> DataFrame:
    """(doc_id, text) in one of: axtree, xml, compact, agent_prompt."""
    t, k = F.col("text"), F.col("type")
    role = F.coalesce(*[F.when(k == a, F.lit(b)) for a, b in _ROLES.items()], F.lit("text"))
    depth = F.repeat(F.lit("  "), F.size("section_path"))
    line = {
        "axtree": F.concat(depth, F.lit("["), F.col("block_id"), F.lit("] "), role, F.lit(' "'), X.truncate(F.replace(t, F.lit("\n"), F.lit(" ")), 200), F.lit('"')),
        "xml": F.concat(F.lit("<"), k, F.lit(' id="'), F.col("block_id"), F.lit('">'), xml_escape(t), F.lit("</"), k, F.lit(">")),
        "compact": F.concat(F.upper(F.substring(k, 1, 1)), F.lit(":"), X.truncate(F.replace(t, F.lit("\n"), F.lit(" ")), 120)),
        "agent_prompt": F.concat(F.lit("- ("), k, F.lit(", "), F.round("importance", 2).cast("string"), F.lit(") "), X.truncate(t, 300)),
    }[style]
    return blocks.groupBy("doc_id").agg(_joined(F.struct("ord", line.alias("t"))).alias("text"))


def function_calls(actions: DataFrame, style: str = "openai") -> DataFrame:
    """(doc_id, tools): actions as tool definitions, fields as flat parameters."""
    name = F.concat_ws("_", "type", F.substring(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), 1, 40))
    fields = F.transform_values(F.map_from_arrays("required_fields", F.transform("required_fields", lambda x: F.lit("string"))), lambda f, v: F.create_map(F.lit("type"), v))
    schema = F.struct(F.lit("object").alias("type"), fields.alias("properties"), F.col("required_fields").alias("required"))
    tool = F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), F.col("label").alias("description"), schema.alias("parameters")).alias("function")) if style == "openai" else F.struct(name.alias("name"), F.col("label").alias("description"), schema.alias("input_schema"))
    return actions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(tool).alias("j")))).alias("x")).select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]")).alias("tools"))


def chat_messages(docs_markdown: DataFrame) -> DataFrame:
    """(doc_id, messages): a system and a user message."""
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("Answer from the page below.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("markdown").alias("content")))
    return docs_markdown.select("doc_id", F.to_json(m).alias("messages"))


def chunks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per block as text and metadata, for document loaders."""
    return blocks.drop("url").join(docs.select("doc_id", "url", "title"), "doc_id").select("doc_id", "block_id", F.col("text").alias("page_content"), F.to_json(F.struct("url", "title", "type", "section_path", F.round("importance", 3).alias("importance"))).alias("metadata"))


def form_guide(actions: DataFrame) -> DataFrame:
    """Fields of forms with whether they are required, by name."""
    return actions.filter("type = 'submit'").select("doc_id", "action_id", "label", F.explode_outer(F.map_entries("value_schema")).alias("f"), "required_fields").select("doc_id", "action_id", "label", F.col("f.key").alias("field"), F.col("f.value").alias("field_type"), F.array_contains("required_fields", F.col("f.key")).alias("required"))


def debug_counts(blocks: DataFrame, actions: DataFrame) -> DataFrame:
    a = blocks.groupBy("doc_id", F.col("type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("block"))
    return a.unionByName(actions.groupBy("doc_id", F.col("type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("action")))
