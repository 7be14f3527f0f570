"""Queries of the operators on blocks, actions and records. Tables of the wanted shape are views of the supplied ones, stated alike in SQL.

Blocks are documents, twenty of them to a page; actions are events, a page for each user. Lists that order blocks or actions are of one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X
from loomstead.operators import align, budget, diff, evaluate, graph, index, provenance, publish, relevance, retrieve, site
from loomstead.plans.catalog import _DENSE, _KEPT, _LINKS, _turns, query
from loomstead.sources import sinks

_BLK = """b AS (SELECT 'p' || (doc_id // 20) AS doc_id, 'b' || doc_id AS block_id, (doc_id % 20)::INT AS ord, CASE doc_id % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'code' WHEN 3 THEN 'list' ELSE 'paragraph' END AS type,
 CASE WHEN doc_id % 5 = 0 THEN (1 + (doc_id // 5) % 3)::INT END AS level, CASE WHEN doc_id % 7 = 0 THEN [] ELSE [lang, source] END AS section_path, (doc_id % 10) / 10.0::DOUBLE AS importance,
 CASE doc_id % 3 WHEN 0 THEN 'html > body > main > article > p' WHEN 1 THEN 'html > body > div > p' ELSE 'html > body > nav' END AS dom_path, text FROM documents)"""


def _blocks(t) -> DataFrame:
    d, i = t("documents"), F.col("doc_id")
    kind = F.when(i % 5 == 0, "heading").when(i % 5 == 1, "table").when(i % 5 == 2, "code").when(i % 5 == 3, "list").otherwise("paragraph")
    return d.select(
        F.concat(F.lit("p"), F.floor(i / 20).cast("string")).alias("doc_id"), F.concat(F.lit("b"), i.cast("string")).alias("block_id"), (i % 20).cast("int").alias("ord"), kind.alias("type"),
        F.when(i % 5 == 0, 1 + F.floor(i / 5) % 3).cast("int").alias("level"), F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("section_path"), ((i % 10) / 10.0).alias("importance"),
        F.when(i % 3 == 0, "html > body > main > article > p").when(i % 3 == 1, "html > body > div > p").otherwise("html > body > nav").alias("dom_path"), "text",
    )


_ACT = """a AS (SELECT 'p' || user_id AS doc_id, 'a' || event_id AS action_id, event_id AS ord, CASE event_id % 5 WHEN 0 THEN 'navigate' WHEN 1 THEN 'submit' WHEN 2 THEN 'download' WHEN 3 THEN 'click' ELSE 'input' END AS type,
 event_type || ' ' || (event_id % 7) AS label, CASE WHEN event_id % 10 = 1 THEN 'submit_login' WHEN event_id % 15 = 0 THEN 'next_page' WHEN event_id % 11 = 0 THEN 'search' END AS role, CASE WHEN event_id % 4 = 0 THEN '' ELSE '#s' || (event_id % 13) END AS selector,
 CASE WHEN event_id % 5 IN (0, 2) THEN 'https://h' || (user_id % 7) || '.example.com/' || event_type || '/v1/x?page=' || (event_id % 3) WHEN event_id % 5 = 1 THEN 'https://h' || (user_id % 7) || '.example.com/api/' || event_type END AS target_url,
 0.5::DOUBLE + (event_id % 5) / 10.0::DOUBLE AS confidence, (event_id % 4) / 4.0::DOUBLE AS priority, event_id % 5 = 0 AS may_navigate, event_id % 5 = 2 AS may_download, event_id % 10 = 3 AS may_open_modal,
 CASE WHEN event_id % 5 = 1 THEN ['user', 'pass'] ELSE [] END AS required_fields FROM events),
d AS (SELECT DISTINCT 'p' || user_id AS doc_id, 'h' || (user_id % 7) AS site_id, 'https://h' || (user_id % 7) || '.example.com/' || user_id AS url, 'User ' || user_id AS title FROM events)"""


def _host() -> F.Column:
    return F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/"))


def _actions(t) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "navigate").when(e % 5 == 1, "submit").when(e % 5 == 2, "download").when(e % 5 == 3, "click").otherwise("input")
    target = F.when((e % 5).isin(0, 2), F.concat(_host(), "event_type", F.lit("/v1/x?page="), (e % 3).cast("string"))).when(e % 5 == 1, F.concat(_host(), F.lit("api/"), "event_type"))
    return t("events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("doc_id"), F.concat(F.lit("a"), e.cast("string")).alias("action_id"), e.alias("ord"), kind.alias("type"), F.concat("event_type", F.lit(" "), (e % 7).cast("string")).alias("label"),
        F.when(e % 10 == 1, "submit_login").when(e % 15 == 0, "next_page").when(e % 11 == 0, "search").alias("role"), F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("#s"), (e % 13).cast("string"))).alias("selector"), target.alias("target_url"),
        (0.5 + (e % 5) / 10.0).alias("confidence"), ((e % 4) / 4.0).alias("priority"), (e % 5 == 0).alias("may_navigate"), (e % 5 == 2).alias("may_download"), (e % 10 == 3).alias("may_open_modal"),
        F.when(e % 5 == 1, F.array(F.lit("user"), F.lit("pass"))).otherwise(F.array().cast("array<string>")).alias("required_fields"),
    )


def _users(t) -> DataFrame:
    u = F.col("user_id")
    return t("events").select(F.concat(F.lit("p"), u.cast("string")).alias("doc_id"), F.concat(F.lit("h"), (u % 7).cast("string")).alias("site_id"), F.concat(_host(), u.cast("string")).alias("url"), F.concat(F.lit("User "), u.cast("string")).alias("title")).distinct()


# --- filters, relevance, plans

_QF = "licensed version license the license"
_QT = {"licensed": 1, "version": 1, "license": 2, "the": 1}
_COUNT = ", ".join(f"len(list_filter(tk, lambda x: x = '{w}'))::BIGINT AS c{k}" for k, w in enumerate(_QT))


@query(f"""WITH {_BLK}, x AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk, regexp_extract_all(lower(array_to_string(section_path, ' ')), '[a-z0-9]+') AS st FROM b), y AS (SELECT *, {_COUNT} FROM x),
z AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, {", ".join(f"count(*) FILTER (c{k} > 0) OVER (PARTITION BY doc_id) AS d{k}" for k in range(4))}, CASE WHEN type = 'heading' AND c0 + c1 + c2 + c3 > 0 THEN ord END AS h FROM y),
w AS (SELECT *, least(ord - max(h) OVER (PARTITION BY doc_id ORDER BY ord), min(h) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - ord) AS away FROM z),
s AS (SELECT *, CASE WHEN len(tk) = 0 THEN 0 ELSE least(1.0, 2 / (1 + exp(-5 * ({" + ".join(f"{m} * c{k} / len(tk) * ln(1 + n / (1.0 + d{k}))" for k, m in enumerate(_QT.values()))}) / 5)) - 1) END AS tfidf,
 ({" + ".join(f"CASE WHEN list_contains(st, '{w}') THEN {m} ELSE 0 END" for w, m in _QT.items())}) / 5.0 AS sec FROM w),
r AS (SELECT *, greatest(0.0, least(1.0, 0.6::DOUBLE * tfidf + 0.2::DOUBLE * sec + 0.2::DOUBLE * coalesce(1 / (1.0::DOUBLE + away), 0))) AS rel FROM s)
SELECT doc_id, block_id, round(rel, 6) AS relevance, round(importance * 0.5 + rel * 0.5, 6) AS importance FROM r WHERE rel >= 0.1""")
def query_filter(t):
    return relevance.query_filter(_blocks(t), _QF).select("doc_id", "block_id", F.round("relevance", 6).alias("relevance"), F.round("importance", 6).alias("importance"))


@query(f"WITH {_BLK} SELECT doc_id, type, count(*) AS n FROM b WHERE type IN ('heading', 'table', 'code') AND importance >= 0.4 GROUP BY ALL")
def block_filters(t):
    return _blocks(t).filter(index.block_filter(["heading", "table", "code"], 0.4)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_BLK}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, ord) AS r FROM b) SELECT doc_id, block_id, ord FROM r WHERE r <= 5")
def block_summaries(t):
    return budget.summary(_blocks(t), 5).select("doc_id", "block_id", "ord")


_PLAN = "show me the source of the licensed version"


def _bm(name: str, src: str, terms: tuple[str, ...]) -> str:
    tok = f"(SELECT key, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM {src})"
    kept = f"(SELECT * FROM {tok} WHERE length(term) > 1 AND term NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)}))"
    cols, idx = ", ".join(f"count(*) FILTER (term = '{w}') AS t{k}" for k, w in enumerate(terms)), range(len(terms))
    return f"""{name}_k AS (SELECT key, count(*) AS dl, {cols} FROM {kept} GROUP BY key), {name}_s AS (SELECT count(*) AS n, avg(dl) AS a, {", ".join(f"count(*) FILTER (t{k} > 0) AS d{k}" for k in idx)} FROM {name}_k),
{name} AS (SELECT key, {" + ".join(f"ln((n - d{k} + 0.5) / (d{k} + 0.5) + 1) * t{k} * 2.5 / (t{k} + 1.5 * (0.25 + 0.75 * dl / a))" for k in idx)} AS score FROM {name}_k, {name}_s WHERE {" + ".join(f"t{k}" for k in idx)} > 0)"""


_HITS = f"""{_BLK}, bs AS (SELECT *, doc_id || ':' || block_id AS key, text AS body, (doc_id[2:]::BIGINT % 10) / 9.0::DOUBLE AS evidence_score FROM b), {_bm("bm", "bs", ("licensed", "version", "source"))},
h AS (SELECT bs.*, bm.score FROM bm JOIN bs USING (key) WHERE importance >= {{floor}} ORDER BY bm.score DESC, key LIMIT 30),
g AS (SELECT *, greatest(0.0, score + 0.15::DOUBLE * least(3, {{section}}) + CASE WHEN importance > 0.7 THEN 0.15::DOUBLE * (importance - 0.5) ELSE 0 END + {{evidence}} - CASE WHEN len(section_path) = 0 THEN 0.05::DOUBLE ELSE 0 END) AS s FROM h)"""


def _sections(words: list[str]) -> str:
    return " + ".join(f"contains(lower(array_to_string(section_path, ' ')), '{w}')::INT" for w in words)


@query("WITH " + _HITS.format(floor=0.7, section=_sections(sorted(set(_PLAN.split()))), evidence="CASE WHEN evidence_score > 0.7 THEN 0.2::DOUBLE * (evidence_score - 0.5) ELSE 0 END").replace("('licensed'", "('licensed'") + " SELECT 'block' AS kind, doc_id, block_id AS id, round(s, 6) AS score FROM g ORDER BY g.s DESC, doc_id, block_id LIMIT 10")
def plan_evidence_top10(t):
    """An evidence plan: only blocks of importance 0.7 or more, evidence counts in re-ranking. Its words after stopwords: show, source, licensed, version."""
    b = _blocks(t).withColumn("evidence_score", (F.substring("doc_id", 2, 18).cast("long") % 10) / 9.0)
    return relevance.by_plan(b, _actions(t), "source licensed version", 10, plan=retrieve.Plan("", "evidence", [retrieve.Step("search_blocks", {"min_importance": relevance.EVIDENCE_FLOOR})], "", 1.0)).select("kind", "doc_id", "id", F.round("score", 6).alias("score"))


@query("WITH " + _HITS.format(floor=0, section=_sections(["licensed", "source", "version"]), evidence="0") + f""", {_ACT}, ac AS (SELECT *, doc_id || ':' || action_id AS key, label || coalesce(' ' || role, '') AS body FROM a), {_bm("am", "ac", ("licensed", "version", "source"))},
u AS (SELECT 'block' AS kind, doc_id, block_id AS id, s FROM g UNION ALL SELECT 'action', doc_id, action_id, am.score FROM am JOIN ac USING (key))
SELECT kind, doc_id, id, round(s, 6) AS score FROM u ORDER BY u.s DESC, kind, doc_id, id LIMIT 10""")
def plan_hybrid_top10(t):
    b = _blocks(t).withColumn("evidence_score", F.lit(0.0))
    return relevance.by_plan(b, _actions(t), "source licensed version", 10, plan=retrieve.Plan("", "hybrid", [retrieve.Step("search_blocks"), retrieve.Step("search_actions")], "", 1.0)).select("kind", "doc_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_ACT}, ac AS (SELECT *, doc_id || ':' || action_id AS key, label || coalesce(' ' || role, '') AS body FROM a), {_bm("am", "ac", ("purchase", "search"))}
SELECT key, round(score, 6) AS score FROM am""")
def bm25_actions(t):
    a = _actions(t).withColumn("key", F.concat_ws(":", "doc_id", "action_id")).withColumn("text", F.concat_ws(" ", "label", "role"))
    return index.bm25(a, "purchase search", top_k=None).select("key", F.round("score", 6).alias("score"))


@query(f"""WITH {_ACT}, s AS (SELECT *, list_distinct(string_split(lower(label), ' ')) AS w FROM a)
SELECT doc_id, action_id, round(0.3 * len(list_intersect(w, ['next', 'purchase', 'search'])) + 0.5 * (contains(coalesce(role, ''), 'next')::INT + contains(coalesce(role, ''), 'purchase')::INT + contains(coalesce(role, ''), 'search')::INT) + 0.1 * priority, 6) AS relevance FROM s""")
def action_relevance(t):
    return _actions(t).select("doc_id", "action_id", F.round(retrieve.action_relevance("search next purchase"), 6).alias("relevance"))


@query(f"""WITH {_KEPT.replace("(SELECT * FROM (", "p0 AS (SELECT * FROM (", 1)}, p AS (SELECT doc_id AS key, term FROM p0 WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'replaced' FROM documents WHERE doc_id % 3 = 0)
SELECT term, count(DISTINCT key) AS df, count(*) AS cf FROM p GROUP BY term""")
def index_upsert(t):
    """Documents divisible by 3 are taken in anew with another text; the statistics follow."""
    d = t("documents").select(F.col("doc_id").alias("key"), "text")
    got = index.add(index.build(d), d.filter("key % 3 = 0").withColumn("text", F.lit("replaced")))
    return got.terms.select("term", "df", "cf")


@query(f"""WITH {_KEPT.replace("(SELECT * FROM (", "p0 AS (SELECT * FROM (", 1)}, l AS (SELECT doc_id, count(*) AS dl FROM p0 WHERE doc_id % 3 <> 0 GROUP BY doc_id) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM l""")
def index_delete(t):
    d = t("documents").select(F.col("doc_id").alias("key"), "text")
    return index.remove(index.build(d), d.filter("key % 3 = 0")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


# --- alignment


@query("""WITH p AS (SELECT page_id, html, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) || CASE WHEN page_id % 2 = 0 THEN '' ELSE repeat(' and more', 20) END AS x FROM pages),
q AS (SELECT page_id, x, trim(substr(x, 1, 80)) AS h, strpos(html, x) AS a, strpos(html, trim(substr(x, 1, 80))) AS c FROM p)
SELECT page_id, CASE WHEN length(x) = 0 THEN NULL WHEN a > 0 THEN a - 1 WHEN length(h) >= 10 AND c > 0 THEN c - 1 END AS first, CASE WHEN length(x) = 0 THEN NULL WHEN a > 0 THEN a - 1 + length(x) WHEN length(h) >= 10 AND c > 0 THEN c - 1 + length(h) END AS "end" FROM q""")
def char_ranges(t):
    p = t("pages").select(F.col("page_id").alias("doc_id"), "html")
    b = p.select("doc_id", F.concat(X.title_tag("html"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.repeat(F.lit(" and more"), F.lit(20)))).alias("text"))
    return align.char_ranges(b, p).select(F.col("doc_id").alias("page_id"), F.col("char_range.first").cast("long").alias("first"), F.col("char_range.end").cast("long").alias("end"))


@query(f"""WITH {_ACT}, p AS (SELECT DISTINCT doc_id, selector, [length(selector)::DOUBLE, 10.0::DOUBLE, 30.0::DOUBLE, 5.0::DOUBLE] AS bb FROM a WHERE selector <> '' AND selector <> '#s5')
SELECT a.doc_id, action_id, CASE WHEN bb IS NOT NULL THEN 'r_' || substr(md5('action_' || action_id), 1, 8) END AS region_id, bb[1] + bb[3] AS "right", bb[2] + bb[4] AS bottom FROM a LEFT JOIN p ON a.doc_id = p.doc_id AND a.selector = p.selector""")
def screenshot_boxes(t):
    a = _actions(t)
    p = a.filter("selector <> '' and selector <> '#s5'").select("doc_id", "selector", F.array(F.length("selector").cast("double"), F.lit(10.0), F.lit(30.0), F.lit(5.0)).alias("bbox")).distinct()
    return align.with_boxes(a, p, "action", "action_id", F.col("selector")).select("doc_id", "action_id", "region_id", F.col("box")[2].alias("right"), F.col("box")[3].alias("bottom"))


@query(f"""WITH {_BLK}, n AS (SELECT doc_id, ord, 'role' || (ord % 3) AS role, trim(lower(CASE WHEN ord % 4 = 0 THEN substr(text, 1, 100) ELSE substr(text, 1, 5 + ord) END)) AS name FROM b WHERE ord < 10),
u AS (SELECT doc_id, name, min(ord) AS f, arg_max(role, ord) AS role FROM n WHERE name <> '' GROUP BY ALL), v AS (SELECT doc_id, substr(name, 1, 50) AS s, arg_min(role, f) AS role, min(f) AS f FROM u GROUP BY ALL), h AS (SELECT *, trim(lower(substr(text, 1, 100))) AS head FROM b)
SELECT h.doc_id, h.block_id, coalesce(any_value(u.role), arg_min(v.role, v.f)) AS ax_role FROM h LEFT JOIN u ON h.doc_id = u.doc_id AND h.head = u.name LEFT JOIN v ON h.doc_id = v.doc_id AND starts_with(h.head, v.s) GROUP BY h.doc_id, h.block_id""")
def ax_roles(t):
    b = _blocks(t)
    n = b.filter("ord < 10").select("doc_id", "ord", F.concat(F.lit("role"), (F.col("ord") % 3).cast("string")).alias("role"), F.when(F.col("ord") % 4 == 0, F.substring("text", 1, 100)).otherwise(F.substring(F.col("text"), F.lit(1), 5 + F.col("ord"))).alias("name"), F.lit(None).cast("array<double>").alias("bbox"))
    return align.with_ax(b, n).select("doc_id", "block_id", "ax_role")


# --- document records, provenance


@query(f"""WITH {_BLK} SELECT doc_id, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE '(root)' END AS section, string_agg(block_id, ',' ORDER BY ord) AS ids FROM b GROUP BY ALL""")
def section_index(t):
    return provenance.section_index(_blocks(t)).select("doc_id", "section", F.array_join("block_ids", ",").alias("ids"))


_NAMES = {k: X.ENTITY[k] for k in ("price", "email", "url", "percentage")}


@query(f"""WITH {_BLK}, e AS ({" UNION ALL ".join(f"SELECT doc_id, ord, {k} AS k, unnest(regexp_extract_all(text, '{p[0].replace(chr(39), chr(39) * 2)}')) AS name, generate_subscripts(regexp_extract_all(text, '{p[0].replace(chr(39), chr(39) * 2)}'), 1) AS pos FROM b" for k, p in enumerate(_NAMES.values()))}),
f AS (SELECT doc_id, name, min((ord, k, pos)) AS place FROM e GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INT AS rank, name FROM f""")
def entity_names(t):
    return provenance.entity_names(_blocks(t), tuple(_NAMES))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '(?is)<title[^>]*>.*?</title>', '') ELSE html END AS html FROM pages),
x AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) AS tag, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h1 FROM p)
SELECT page_id, regexp_replace(CASE WHEN tag <> '' THEN tag ELSE h1 END, '&[a-z]+;|[^a-zA-Z]', '', 'g') AS letters FROM x""")
def page_titles(t):
    first = F.regexp_replace("html", "(?is)^(.*?)<title[^>]*>.*?</title>", "$1")  # of several titles one goes, as in the SQL
    p = t("pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 2 == 0, first).otherwise(F.col("html")).alias("html"))
    return provenance.titles(p).select(F.col("doc_id").alias("page_id"), F.regexp_replace("title", "&[a-z]+;|[^a-zA-Z]", "").alias("letters"))


@query(f"""WITH {_BLK}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS r FROM b WHERE type IN ('heading', 'paragraph'))
SELECT doc_id, md5(string_agg(CASE WHEN type = 'paragraph' THEN substr(text, 1, 200) ELSE text END, ' | ' ORDER BY ord)) AS summary FROM k WHERE r <= CASE type WHEN 'heading' THEN 2 ELSE 1 END GROUP BY doc_id""")
def doc_summaries(t):
    return budget.doc_summary(_blocks(t)).select("doc_id", F.md5("summary").alias("summary"))


@query(f"""WITH {_BLK}, {_ACT}, e AS (SELECT 'https://x.example.com/' || doc_id AS url, doc_id, block_id AS ref, CASE type WHEN 'table' THEN 'table_cell' WHEN 'code' THEN 'code_block' ELSE 'web_block' END AS kind, importance AS confidence FROM b
 UNION ALL SELECT d.url, a.doc_id, a.action_id, 'action', a.confidence FROM a JOIN d USING (doc_id))
SELECT 'ev_' || substr(sha256(url || '|' || doc_id || '|' || ref), 1, 12) AS evidence_id, kind, doc_id, ref, round(confidence, 6) AS confidence FROM e""")
def evidence_rows(t):
    b = _blocks(t).withColumn("url", F.concat(F.lit("https://x.example.com/"), "doc_id"))
    return retrieve.evidence(b, _actions(t).join(_users(t).select("doc_id", "url"), "doc_id")).select("evidence_id", "kind", "doc_id", "ref", F.round("confidence", 6).alias("confidence"))


@query("""WITH s AS (SELECT 'https://x.example.com/' || source AS url, doc_id::VARCHAR AS doc_id, sha256(CASE WHEN coalesce(length(text), 0) > 0 THEN text ELSE coalesce(lang, '') END) AS h, doc_id AS secs FROM documents),
i AS (SELECT *, 'snap_' || substr(sha256(url || '|' || doc_id || '|' || h || '|' || strftime(TIMESTAMP '2024-01-01' + to_seconds(secs), '%Y-%m-%d %H:%M:%S')), 1, 12) AS snapshot_id FROM s),
v AS (SELECT *, row_number() OVER w AS version, lag(h) OVER w AS before FROM i WINDOW w AS (PARTITION BY url ORDER BY secs, snapshot_id)) SELECT snapshot_id, doc_id, version, before IS NULL OR before <> h AS changed FROM v""")
def snapshot_history(t):
    d = t("documents").select(F.concat(F.lit("https://x.example.com/"), "source").alias("url"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("markdown"), F.col("lang").alias("title"), F.col("doc_id").alias("at"))
    return provenance.history(provenance.capture(d, F.timestamp_seconds(F.lit(1704067200) + F.col("at")))).select("snapshot_id", "doc_id", "version", "changed")


@query(f"""WITH {_BLK}, s AS (SELECT *, {", ".join(f"max(CASE WHEN level = {k} THEN ord END) OVER w AS o{k}, arg_max(CASE WHEN level = {k} THEN text END, CASE WHEN level = {k} THEN ord END) OVER w AS t{k}" for k in (1, 2, 3))} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, block_id, md5(coalesce(CASE WHEN o1 IS NOT NULL THEN t1 || '|' END, '') || coalesce(CASE WHEN o2 > coalesce(o1, -1) THEN t2 || '|' END, '') || coalesce(CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN t3 || '|' END, '')) AS path FROM s""")
def section_paths(t):
    from loomstead.operators import parse

    return parse.section_paths(_blocks(t)).select("doc_id", "block_id", F.md5(F.concat_ws("", F.transform("path", lambda x: F.concat(x, F.lit("|"))))).alias("path"))


# --- actions and graphs

_EDGES = """e AS (SELECT doc_id, action_id, ord, CASE WHEN type = 'navigate' THEN 'page' WHEN type = 'submit' THEN 'form_result' WHEN type = 'download' THEN 'download' WHEN may_open_modal THEN 'modal' END AS node_type, label, role, type, target_url FROM a),
n AS (SELECT *, CASE node_type WHEN 'page' THEN 'nav_' WHEN 'form_result' THEN 'form_' ELSE node_type || '_' END || substr(sha256(CASE WHEN node_type IN ('page', 'download') THEN coalesce(target_url, action_id) ELSE action_id END), 1, 8) AS target,
 CASE WHEN type = 'navigate' AND role IS NOT NULL THEN role || ': ' || label ELSE label END AS edge_label FROM e WHERE node_type IS NOT NULL)"""


@query(f"WITH {_ACT}, {_EDGES} SELECT doc_id, action_id, target, node_type, edge_label FROM n")
def nav_edges(t):
    return graph.nav_edges(_actions(t)).select("doc_id", "action_id", "target", "node_type", "edge_label")


@query(f"WITH {_ACT}, {_EDGES} SELECT doc_id, target AS node_id, arg_min(node_type, ord) AS node_type, arg_min(CASE WHEN node_type <> 'modal' THEN coalesce(target_url, '') ELSE '' END, ord) AS url FROM n GROUP BY ALL")
def nav_nodes(t):
    return graph.nav_nodes(graph.nav_edges(_actions(t))).select("doc_id", "node_id", "node_type", F.coalesce("url", F.lit("")).alias("url"))


@query(f"WITH {_ACT}, {_EDGES} SELECT doc_id, target, string_agg(action_id, ',' ORDER BY action_id) AS action_ids FROM n WHERE node_type = 'form_result' GROUP BY ALL")
def form_flows(t):
    return graph.form_flows(graph.nav_edges(_actions(t))).select("doc_id", "target", F.array_join("action_ids", ",").alias("action_ids"))


@query(f"WITH {_ACT}, {_EDGES} SELECT doc_id, action_id, edge_label FROM n WHERE edge_label LIKE '%next_page%'")
def pagination_edges(t):
    return graph.pagination_chain(graph.nav_edges(_actions(t))).select("doc_id", "action_id", "edge_label")


_GRAPH = """st AS (SELECT 'state_' || substr(sha256(doc_id), 1, 12) AS state_id, doc_id, url FROM d), kn AS (SELECT url, max(state_id) AS known FROM st GROUP BY url),
tr AS (SELECT st.state_id AS from_state, CASE WHEN known IS NOT NULL THEN known WHEN target_url IS NOT NULL THEN 'state_' || substr(sha256(target_url), 1, 12) ELSE st.state_id END AS to_state, action_id, target_url, known,
 CASE WHEN may_open_modal THEN 'open_modal' WHEN type = 'navigate' THEN 'navigate' WHEN type = 'submit' THEN 'submit_form' WHEN type = 'download' THEN 'download' WHEN type = 'input' THEN 'filter' ELSE 'unknown' END AS effect FROM a JOIN st USING (doc_id) LEFT JOIN kn ON target_url = kn.url)"""


def _linked(t) -> tuple[DataFrame, DataFrame]:
    """Pages and actions, one in three of which leads to the next user's page."""
    step = F.concat(_host(), F.col("user_id").cast("string"))
    to = t("events").filter("event_id % 15 = 0").select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("action_id"), step.alias("own"))
    a = _actions(t).join(to, "action_id", "left").withColumn("target_url", F.coalesce("own", "target_url")).drop("own")
    return _users(t), a


_LINKED = _ACT.replace("a AS (SELECT", "a0 AS (SELECT", 1) + ", a AS (SELECT a0.* REPLACE (CASE WHEN ord % 15 = 0 THEN d.url ELSE target_url END AS target_url) FROM a0 JOIN d USING (doc_id))"


@query(f"WITH {_LINKED}, {_GRAPH} SELECT from_state, to_state, action_id, effect FROM tr")
def action_graph_transitions(t):
    return graph.action_graph(*_linked(t))[1].select("from_state", "to_state", "action_id", "effect")


@query(f"WITH {_LINKED}, {_GRAPH} SELECT state_id, url, false AS placeholder FROM st UNION ALL SELECT DISTINCT to_state, target_url, true FROM tr WHERE known IS NULL AND target_url IS NOT NULL")
def action_graph_states(t):
    return graph.action_graph(*_linked(t))[0].select("state_id", "url", "placeholder")


_API = """k AS (SELECT a.*, CASE WHEN type = 'submit' THEN coalesce(target_url, d.url) ELSE target_url END AS endpoint, CASE WHEN type = 'submit' AND coalesce(role, '') <> 'search' THEN 'POST' ELSE 'GET' END AS method FROM a JOIN d USING (doc_id)),
f AS (SELECT *, CASE WHEN type = 'submit' THEN least(0.95, round(0.3 + 0.3 + 0.2 * confidence + 0.1, 2)) WHEN type = 'download' THEN 0.8 ELSE least(0.9, 0.5 + 0.2 + 0.1) END AS c,
 CASE WHEN method = 'GET' THEN 'read_only' WHEN coalesce(role, '') LIKE '%login%' THEN 'auth_required' ELSE 'write' END AS safety, row_number() OVER (PARTITION BY doc_id, method, endpoint ORDER BY ord) AS r FROM k WHERE type IN ('submit', 'navigate', 'download')),
ap AS (SELECT * FROM f WHERE r = 1)"""


@query(f"WITH {_ACT}, {_API} SELECT doc_id, action_id, endpoint, method, CASE WHEN type = 'submit' THEN 'user,pass' ELSE 'page' END AS params, round(c, 6) AS confidence, safety, CASE WHEN safety = 'read_only' AND c >= 0.7 THEN 'api' WHEN safety <> 'read_only' THEN 'confirm' ELSE 'browser' END AS mode FROM ap")
def api_candidates(t):
    c = graph.api_candidates(_actions(t).join(_users(t).select("doc_id", "url"), "doc_id"))
    return c.select("doc_id", "action_id", "endpoint", "method", F.array_join("params", ",").alias("params"), F.round("confidence", 6).alias("confidence"), "safety", "mode")


@query(f"""WITH {_ACT}, {_API}, m AS (SELECT a.doc_id, a.action_id, a.confidence, ap.endpoint, ap.c, ap.safety, ap.action_id AS ca, CASE WHEN ap.action_id = a.action_id THEN 0 WHEN a.target_url IS NOT NULL AND ap.endpoint IS NOT NULL AND (contains(ap.endpoint, a.target_url) OR contains(a.target_url, ap.endpoint)) THEN 1 ELSE 2 END AS rank FROM a LEFT JOIN ap USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, action_id ORDER BY rank, c DESC NULLS LAST, ca NULLS FIRST, endpoint) AS r FROM m),
x AS (SELECT *, CASE WHEN rank < 2 AND safety = 'read_only' AND c >= 0.7 THEN 'api' WHEN rank < 2 AND safety IN ('write', 'auth_required') THEN 'confirm' WHEN rank < 2 AND c >= 0.7 THEN 'api' ELSE 'browser' END AS mode FROM o WHERE r = 1)
SELECT doc_id, action_id, mode, round(CASE WHEN mode = 'browser' THEN confidence ELSE c END, 6) AS confidence, CASE WHEN mode <> 'browser' THEN endpoint ELSE '' END AS endpoint FROM x""")
def mode_decisions(t):
    a = _actions(t).join(_users(t).select("doc_id", "url"), "doc_id")
    return graph.decide(a, graph.api_candidates(a)).select("doc_id", "action_id", "mode", F.round("confidence", 6).alias("confidence"), F.coalesce("endpoint", F.lit("")).alias("endpoint"))


@query(f"""WITH {_ACT}, {_API} SELECT doc_id, action_id, method, CASE WHEN method = 'GET' THEN endpoint || CASE WHEN contains(endpoint, '?') THEN '&' ELSE '?' END || CASE WHEN type = 'submit' THEN 'pass=secret&user=a+b' ELSE 'page=7' END ELSE endpoint END AS url,
 CASE WHEN method = 'POST' THEN 'pass=secret&user=a b' ELSE '' END AS body FROM ap""")
def call_specs(t):
    c = graph.api_candidates(_actions(t).join(_users(t).select("doc_id", "url"), "doc_id"))
    known = F.create_map(F.lit("page"), F.lit("7"), F.lit("user"), F.lit("a b"), F.lit("pass"), F.lit("secret"))
    s = graph.call_specs(c, known)
    return s.select("doc_id", "action_id", "method", "call_url", F.array_join(F.array_sort(F.transform(F.map_entries("body"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&").alias("body")).withColumnRenamed("call_url", "url").withColumn("body", F.coalesce("body", F.lit("")))


@query(f"""WITH {_ACT}, c AS (SELECT *, CASE WHEN coalesce(role, '') LIKE '%search%' THEN 'search' WHEN coalesce(role, '') LIKE '%login%' THEN 'authenticate' WHEN role = 'next_page' THEN 'paginate' WHEN type = 'download' THEN 'download' WHEN type = 'submit' THEN 'submit_form' WHEN type = 'navigate' THEN 'navigate' ELSE 'interact' END AS cap FROM a JOIN d USING (doc_id))
SELECT site_id, string_agg(DISTINCT cap, ',' ORDER BY cap) AS capabilities FROM c GROUP BY site_id""")
def site_capabilities(t):
    return publish.actions_feed(_users(t), _actions(t)).select("site_id", F.array_join("capabilities", ",").alias("capabilities"))


@query(f"WITH {_ACT} SELECT doc_id, action_id, CASE WHEN type IN ('click', 'submit', 'download') THEN 'click' WHEN type = 'input' THEN 'fill' ELSE type END AS command FROM a")
def browser_commands(t):
    return _actions(t).select("doc_id", "action_id", retrieve.browser_command(F.col("type")).alias("command"))


@query(f"""WITH {_ACT}, k AS (SELECT doc_id, ord, CASE WHEN selector <> '' THEN selector ELSE label END AS key, type, role, label, ord % 2 AS side FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key, side ORDER BY ord) AS nth FROM k),
o AS (SELECT * FROM n WHERE side = 0), w AS (SELECT * FROM n WHERE side = 1)
SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, coalesce(o.key, w.key) AS key, coalesce(o.nth, w.nth)::INT AS nth, CASE WHEN o.key IS NULL THEN 'added' WHEN w.key IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM o FULL JOIN w ON o.doc_id = w.doc_id AND o.key = w.key AND o.nth = w.nth WHERE o.key IS NULL OR w.key IS NULL OR o.type <> w.type OR o.role IS DISTINCT FROM w.role OR o.label <> w.label""")
def action_changes(t):
    a = _actions(t)
    return diff.action_changes(a.filter("ord % 2 = 0"), a.filter("ord % 2 = 1"))


@query(f"WITH {_BLK}, {_ACT} SELECT doc_id, type AS kind, count(*) AS n, 'block' AS what FROM b GROUP BY ALL UNION ALL SELECT doc_id, type, count(*), 'action' FROM a GROUP BY ALL")
def debug_counts(t):
    return publish.debug_counts(_blocks(t), _actions(t))


# --- rendering and publishing


@query(f"""WITH {_BLK} SELECT doc_id, md5(string_agg(CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY ord)) AS markdown FROM b GROUP BY doc_id""")
def block_markdown(t):
    return budget.markdown(_blocks(t).withColumn("meta", F.lit("{}"))).select("doc_id", F.md5("markdown").alias("markdown"))


@query(f"""WITH {_BLK} SELECT doc_id, md5(string_agg('<' || type || ' id="' || block_id || '">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</' || type || '>', chr(10) ORDER BY ord)) AS text FROM b GROUP BY doc_id""")
def block_xml(t):
    return publish.format_blocks(_blocks(t), "xml").select("doc_id", F.md5("text").alias("text"))


@query(f"""WITH {_BLK}, o AS (SELECT *, replace(text, chr(10), ' ') AS x FROM b) SELECT doc_id, md5(string_agg(repeat('  ', len(section_path)) || '[' || block_id || '] ' || CASE type WHEN 'paragraph' THEN 'text' ELSE type END || ' "' || CASE WHEN length(x) <= 200 THEN x ELSE rtrim(substr(x, 1, 197), ' ') || '...' END || '"', chr(10) ORDER BY ord)) AS text FROM o GROUP BY doc_id""")
def block_axtree(t):
    return publish.format_blocks(_blocks(t), "axtree").select("doc_id", F.md5("text").alias("text"))


@query(f"""WITH {_ACT}, {_BLK}, n AS (SELECT d.*, coalesce(c.n, 0) AS n FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) c USING (doc_id)),
l AS (SELECT site_id, string_agg('- [' || title || '](' || url || '): ' || n || ' blocks', chr(10) ORDER BY n DESC, url) AS body FROM (SELECT *, 1 AS k FROM n) GROUP BY site_id), s AS (SELECT *, initcap_ AS section FROM (SELECT n.*, regexp_extract(regexp_replace(url, '^https://[^/]*', ''), '^/([^/]+)', 1) AS initcap_ FROM n)),
p AS (SELECT site_id, section, string_agg('- [' || title || '](' || url || '): ' || n || ' blocks', chr(10) ORDER BY n DESC, url) AS lines FROM s GROUP BY ALL), y AS (SELECT site_id, string_agg('## ' || section || chr(10) || lines, chr(10) || chr(10) ORDER BY section) AS body FROM p GROUP BY site_id),
r AS (SELECT site_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles FROM a JOIN d USING (doc_id) WHERE role IS NOT NULL GROUP BY site_id)
SELECT site_id, md5('# ' || site_id || chr(10) || chr(10) || y.body || coalesce(chr(10) || chr(10) || '## Actions' || chr(10) || roles, '')) AS llms_txt FROM y LEFT JOIN r USING (site_id)""")
def llms_txt(t):
    return publish.llms_txt(_users(t), _blocks(t), _actions(t), limit=None).select("site_id", F.md5("llms_txt").alias("llms_txt"))


@query(f"""WITH {_ACT}, {_BLK}, k AS (SELECT doc_id, type, count(*) AS n, min(ord) AS o FROM b GROUP BY ALL), ks AS (SELECT doc_id, string_agg(type, ',' ORDER BY n DESC, o) AS types FROM k GROUP BY doc_id), im AS (SELECT doc_id, round(avg(importance), 2) AS imp FROM b GROUP BY doc_id)
SELECT site_id, md5('<agent-sitemap>' || chr(10) || string_agg('  <page><loc>' || url || '</loc><importance>' || coalesce(imp::VARCHAR, '0.0') || '</importance><content>' || coalesce(types, '') || '</content></page>', chr(10) ORDER BY url) || chr(10) || '</agent-sitemap>') AS sitemap
FROM d LEFT JOIN ks USING (doc_id) LEFT JOIN im USING (doc_id) GROUP BY site_id""")
def sitemap(t):
    return publish.sitemap(_users(t), _blocks(t)).select("site_id", F.md5("sitemap").alias("sitemap"))


@query("""WITH p AS (SELECT page_id, '# s' || chr(10) || '- `#sel' || page_id || '`: x' || chr(10) || '- `GET ' || url || '`' AS md, url FROM pages) SELECT page_id, '#sel' || page_id AS selectors, regexp_extract(url, 'https?://[^\\s`)]+') AS urls FROM p""")
def skill_parse(t):
    p = t("pages").select("page_id", F.concat(F.lit("# s\n- `#sel"), F.col("page_id").cast("string"), F.lit("`: x\n- `GET "), "url", F.lit("`")).alias("skill_md"))
    return publish.parse_skill(p).select("page_id", F.array_join("selectors", ",").alias("selectors"), F.array_join("urls", ",").alias("urls"))


@query(f"""WITH {_BLK} SELECT doc_id, block_id, round(CASE WHEN contains(dom_path, 'article') AND contains(dom_path, 'p') OR contains(dom_path, 'nav') THEN least(1.0, importance + 0.25) ELSE importance END, 6) AS importance FROM b""")
def skill_hints(t):
    b = _blocks(t)
    h = b.sparkSession.createDataFrame([("article p",), ("nav",), ("#none",)], "selector string")
    return publish.apply_hints(b, h).select("doc_id", "block_id", F.round("importance", 6).alias("importance"))


@query(f"""WITH {_BLK}, x AS (SELECT *, trim(text) <> '' AS ok FROM b) SELECT doc_id, count(*) AS block_count, count(*) - count(DISTINCT text) > 0 AS repeats, count(*) FILTER (type = 'heading') = 0 AS bare FROM x WHERE ok GROUP BY doc_id""")
def block_quality(t):
    q = site.quality(_blocks(t))
    return q.select("doc_id", "block_count", (F.col("dup_texts") > 0).alias("repeats"), F.array_contains("warnings", "no headings").alias("bare"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda x: length(trim(x, ' ')) > 0), lambda x: '<p>' || trim(x, ' ') || '</p>'), chr(10))) AS html FROM documents""")
def plain_text_pages(t):
    return t("documents").select("doc_id", F.md5(X.plain_to_html("text")).alias("html"))


# --- memory, profiles, measures


@query("""WITH p AS (SELECT source AS domain, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), k AS (SELECT source AS domain, CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS type, count(*) AS n FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, type) AS rank FROM k JOIN p USING (domain)) SELECT domain, type, n, rank::INT AS rank FROM r WHERE rank <= 3""")
def memory_types(t):
    d = t("documents")
    b = d.select(F.col("source").alias("domain"), "doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "a").when(F.col("doc_id") % 5 == 1, "b").when(F.col("doc_id") % 5 == 2, "c").otherwise("d").alias("type"))
    none = b.select("domain", F.lit("").alias("url"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("role"), "doc_id").filter("doc_id < 0")
    return site.memory_patterns(b, none, none)["top_types"]


@query(f"""WITH {_ACT}, v AS (SELECT site_id AS domain, doc_id, role FROM a JOIN d USING (doc_id)), p AS (SELECT domain, count(DISTINCT doc_id) AS pages FROM v GROUP BY domain HAVING count(DISTINCT doc_id) >= 3)
SELECT domain, role, round(count(DISTINCT doc_id) / any_value(pages), 6) AS share FROM v JOIN p USING (domain) WHERE role IS NOT NULL GROUP BY domain, role HAVING count(DISTINCT doc_id) >= 0.5 * any_value(pages)""")
def memory_roles(t):
    a = _actions(t).join(_users(t).select("doc_id", F.col("site_id").alias("domain")), "doc_id")
    visits = a.select("domain", F.lit("").alias("url"), F.col("ord").alias("seq")).filter("seq < 0")
    return site.memory_patterns(a.select("domain", "doc_id", F.col("label").alias("text"), "type"), a, visits)["roles"].select("domain", "role", F.round("share", 6).alias("share"))


@query(_LINKS + """, h AS (SELECT DISTINCT url AS page, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain, regexp_replace(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS path FROM l), p AS (SELECT domain, count(DISTINCT page) AS pages FROM h GROUP BY domain HAVING count(DISTINCT page) >= 3)
SELECT domain, path AS text, round(count(*) / any_value(pages), 6) AS share FROM h JOIN p USING (domain) GROUP BY domain, path HAVING count(*) >= 0.7 * any_value(pages)""")
def memory_texts(t):
    l = site.links(t("pages"))  # noqa: E741
    b = l.select(F.col("url").alias("doc_id"), X.netloc("url").alias("domain"), F.regexp_replace("link", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "").alias("text"), F.lit("list").alias("type"))
    none = b.select("domain", "doc_id", F.lit(None).cast("string").alias("role"), F.lit("").alias("url"), F.lit(0).alias("seq")).filter("false")
    return site.memory_patterns(b, none, none)["template_texts"].select("domain", "text", F.round("share", 6).alias("share"))


@query("""WITH c AS (SELECT 'h' || (user_id % 7) AS domain, user_id AS doc_id, 'div.' || event_type || (event_id % 3) AS key, CASE WHEN event_id % 3 = 0 THEN 'site-header' WHEN event_id % 3 = 1 THEN event_type ELSE 'ad box' END AS classes, md5(user_id::VARCHAR) AS tx FROM events),
p AS (SELECT domain, count(DISTINCT doc_id) AS pages FROM c GROUP BY domain), k AS (SELECT domain, key, classes, count(DISTINCT doc_id) AS n, count(DISTINCT tx) / count(*) AS u FROM c GROUP BY ALL), j AS (SELECT k.*, pages, row_number() OVER (PARTITION BY domain ORDER BY u DESC, n DESC, key) AS r FROM k JOIN p USING (domain) WHERE pages >= 2)
SELECT domain, key, round(n / pages, 6) AS share, round(u, 6) AS unique_ratio, coalesce(CASE WHEN contains(classes, 'header') THEN 'header' WHEN classes = 'ad box' THEN 'noise' WHEN r = 1 AND u > 0.5 THEN 'main' WHEN n / pages >= 0.7 THEN 'template' END, '') AS kind, n / pages >= 0.7 AS in_template FROM j""")
def profile_kinds(t):
    e = F.col("event_id")
    c = t("events").select(F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("domain"), F.col("user_id").alias("doc_id"), F.concat(F.lit("div."), "event_type", (e % 3).cast("string")).alias("key"), F.lit("div").alias("tag"), F.when(e % 3 == 0, "site-header").when(e % 3 == 1, F.col("event_type")).otherwise("ad box").alias("classes"), F.col("user_id").cast("string").alias("text"))
    return site.learn_profiles(c).select("domain", "key", F.round("share", 6).alias("share"), F.round("unique_ratio", 6).alias("unique_ratio"), F.coalesce("kind", F.lit("")).alias("kind"), "in_template")


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS a, {_STRIP} AS b FROM pages), n AS (SELECT page_id, CASE WHEN a = '' THEN 0 ELSE greatest(1, len(string_split(a, ' ')) * 13 // 10) END AS raw, CASE WHEN b = '' THEN 0 ELSE greatest(1, len(string_split(b, ' ')) * 13 // 10) END AS done FROM p)
SELECT page_id, raw::BIGINT AS raw_tokens, done::BIGINT AS compiled_tokens, round(raw / nullif(done, 0), 2) AS compression FROM n""")
def token_efficiency(t):
    return t("pages").select("page_id", evaluate.token_efficiency(F.col("html"), X.strip_tags("html")).alias("e")).select("page_id", "e.*")


@query("""WITH q AS (SELECT conv_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+')[1:2] AS kw FROM conversations WHERE turn = (SELECT min(turn) FROM conversations)), r AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, lower(text) AS text FROM conversations),
h AS (SELECT q.query_id, min(rank) AS f FROM q JOIN r ON q.query_id = r.query_id AND len(list_filter(kw, lambda w: NOT contains(text, w))) = 0 GROUP BY q.query_id)
SELECT query_id, CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END AS recall_1, CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0 END AS recall_3, round(coalesce(1.0::DOUBLE / f, 0), 6) AS reciprocal_rank FROM q LEFT JOIN h USING (query_id)""")
def search_quality(t):
    c = t("conversations")
    first = c.agg(F.min("turn").alias("_first"))
    items = c.join(F.broadcast(first), F.col("turn") == F.col("_first")).select(F.col("conv_id").alias("query_id"), F.slice(X.tokens("text"), 1, 2).alias("keywords"))
    results = c.select(F.col("conv_id").alias("query_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("rank"), "text")
    return evaluate.search_quality(results, items, (1, 3)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(f"""WITH {_ACT}, f AS (SELECT doc_id, type, label, count(*) AS n FROM a WHERE ord % 3 <> 0 GROUP BY ALL), e AS (SELECT doc_id, type, label, count(*) AS m FROM a WHERE ord % 4 <> 0 GROUP BY ALL), j AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM f FULL JOIN e USING (doc_id, type, label)),
s AS (SELECT doc_id, coalesce(sum(least(n, m)) / nullif(sum(n), 0), 0) AS p, coalesce(sum(least(n, m)) / nullif(sum(m), 0), 0) AS r FROM j GROUP BY doc_id) SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s""")
def action_accuracy(t):
    a = _actions(t)
    return evaluate.precision_recall(a.filter("ord % 3 <> 0"), a.filter("ord % 4 <> 0"), ["type", "label"]).select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_BLK}, x AS (SELECT doc_id, list(lower(trim(text, ' '))) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'table') AS tb, lower(string_agg(text, ' ' ORDER BY ord)) AS al FROM b GROUP BY doc_id),
y AS (SELECT *, [w for w in ['the', 'la', 'und', 'zzz'] if len([z for z in h if contains(z, w)]) > 0] AS hit, [w for w in ['version', 'licensed', 'zzz'] if contains(al, w)] AS ph FROM x)
SELECT doc_id, round(len(hit) / 4.0, 6) AS heading_fidelity, round(least(1.0, tb / 5.0), 6) AS table_fidelity, round(len(ph) / 3.0, 6) AS text_coverage FROM y""")
def content_fidelity(t):
    b = _blocks(t)
    e = b.select("doc_id").distinct().select("doc_id", F.array(*map(F.lit, ("the", "la", "und", "zzz"))).alias("headings"), F.lit(5).alias("tables"), F.lit(0).alias("codes"), F.array(*map(F.lit, ("version", "Licensed", "zzz"))).alias("phrases"))
    return evaluate.fidelity(b, e).select("doc_id", *[F.round(c, 6).alias(c) for c in ("heading_fidelity", "table_fidelity", "text_coverage")])


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'e' || (doc_id % 5) END AS etag, CASE WHEN doc_id % 3 = 0 THEN 'm' || (doc_id % 4) END AS lm, doc_id % 5000 AS age FROM documents)
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN etag IS NOT NULL AND doc_id % 7 <> 0 THEN etag = 'e1' OR etag = 'e2' WHEN lm IS NOT NULL THEN lm = 'm1' ELSE age <= 3600 END AS fresh FROM d""")
def cache_freshness(t):
    i = F.col("doc_id")
    d = t("documents").select(i.cast("string").alias("doc_id"), F.when(i % 2 == 0, F.concat(F.lit("e"), (i % 5).cast("string"))).alias("etag"), F.when(i % 3 == 0, F.concat(F.lit("m"), (i % 4).cast("string"))).alias("last_modified"), F.timestamp_seconds(F.lit(1704067200) - i % 5000).alias("cached_at"), F.lit(3600).cast("long").alias("ttl_seconds"))
    heads = t("documents").select(i.cast("string").alias("doc_id"), F.when(i % 7 != 0, F.when(i % 5 == 2, "e2").otherwise("e1")).alias("etag_now"), F.lit("m1").alias("last_modified_now"))
    return sinks.freshness(d, heads, F.timestamp_seconds(F.lit(1704067200))).select("doc_id", "fresh")


# --- plans, spans, crawl


@query(r"""WITH k AS (SELECT conv_id || ':' || turn AS key, CASE WHEN regexp_matches(text, '(?i)\b(log\s*in|login|sign\s*in|signin)\b') THEN 'login' WHEN regexp_matches(text, '(?i)\b(search|find|look\s+up)\b') THEN 'search' WHEN regexp_matches(text, '(?i)\bdownload\b') THEN 'download'
 WHEN regexp_matches(text, '(?i)\b(fill|submit|register|sign\s*up)\b') THEN 'fill' WHEN regexp_matches(text, '(?i)\b(go\s+to|navigate|open|visit)\b') THEN 'navigate' ELSE 'actions' END AS pattern FROM conversations WHERE role = 'user'),
s AS (SELECT *, CASE pattern WHEN 'login' THEN ['navigate', 'fill:username', 'fill:password', 'submit'] WHEN 'search' THEN ['fill:query', 'submit', 'read'] WHEN 'download' THEN ['find', 'download'] WHEN 'fill' THEN ['fill', 'submit'] WHEN 'navigate' THEN ['navigate'] ELSE ['click'] END AS c FROM k)
SELECT key, pattern, pattern = 'login' AS needs_auth, generate_subscripts(c, 1)::INT AS step, unnest(c) AS command FROM s""")
def task_steps(t):
    c = t("conversations").filter("role = 'user'").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return retrieve.task_steps(c)


def _words(name: str) -> str:
    return rf"list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower(trim({name}, ' ')), '\s+'), lambda w: length(w) > 2), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: length(w) > 0))"


@query(rf"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'),
s AS (SELECT conv_id, turn, text, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT *, string_split(regexp_replace(trim(answer, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM p)),
w AS (SELECT *, {_words("sentence")} AS a, {_words("text")} AS b FROM s), o AS (SELECT *, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS j FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY j DESC, pos) AS r FROM o) SELECT conv_id, turn, pos::INT AS pos, sentence, round(j, 6) AS overlap FROM r WHERE r = 1""")
def answer_sentences(t):
    return retrieve.answer_span(_turns(t), ["conv_id", "turn"]).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {_DENSE} SELECT key, round(score, 6) AS score FROM d WHERE score > 0""")
def dense_all(t):
    e = t("embeddings").withColumnRenamed("vec_id", "key")
    return index.dense(e, e.filter("key = 7").select(F.col("embedding").alias("q")), top_k=None).select("key", F.round("score", 6).alias("score"))
