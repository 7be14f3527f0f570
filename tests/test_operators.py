"""Operators on small in-line rows, and every registered query against its SQL."""

import glob
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from loomstead.functions import text as X
from loomstead.operators import budget, diff, graph, index, parse, publish, retrieve, site
from loomstead.plans import catalog, session
from loomstead.sources import readers
from loomstead.streaming import streams

from .test_dom import PAGE


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("d1", "s.example.com", "https://s.example.com/guide/a", PAGE), ("d2", "s.example.com", "https://s.example.com/guide/b", PAGE.replace("Guide", "Other").replace("Second one", "Another line")), ("d3", "t.example.com", "https://t.example.com/", "<p>short</p>"), ("d4", "t.example.com", "https://t.example.com/n", None)]
    return spark.createDataFrame(rows, "doc_id string, site_id string, url string, html string")


@pytest.fixture(scope="module")
def parsed(pages):
    return session.scored_blocks(pages, parse.blocks(pages)).cache(), parse.actions(pages).join(pages.select("doc_id", "url"), "doc_id").cache()


def test_text_functions(spark):
    r = one(
        spark, w=X.word_count(F.lit("  a b\n c ")), t=X.tokens_by_words(F.lit("a b c d")), z=X.tokens_by_words(F.lit(" ")), cut=X.truncate(F.lit("abcdefghij"), 8), s=X.sentences(F.lit("One. Two! Three")),
        u=X.normalize_url(F.lit("http://h/a/#x")), root=X.normalize_url(F.lit("http://h/")), ext=X.non_html(F.lit("http://h/a.PDF?x")), slug=X.domain_slug(F.lit("www.my.site.com")), red=X.redact(F.lit("http://h/?token=1&a=2")),
        plain=X.plain_to_html(F.lit("a<b\n\nc")), js=X.looks_json(F.lit(' {"a": 1}')), njs=X.looks_json(F.lit("{a")), b=X.looks_binary(F.lit("\x01\x02ab")), local=X.site_id(F.lit(""), F.lit("/x/dir/f.html")),
    )
    assert (r.w, r.t, r.z, r.cut, r.s) == (3, 5, 0, "abcde...", ["One.", "Two!", "Three"])
    assert (r.u, r.root, r.ext, r.slug, r.red) == ("http://h/a", "http://h/", True, "my-site", "http://h/?token=<redacted>&a=2")
    assert (r.plain, r.js, r.njs, r.b, r.local) == ("<p>a&lt;b</p>\n<p>c</p>", True, False, True, "local:dir")


def test_entities(spark):
    t = F.lit("On March 15, 2026 or 2026-03-15 pay $1,299.00 to A.b@x.org, 85% of 40mm at https://x.org/a?b. Call +1-555-123-4567")
    r = one(spark, **{k: X.entities(t, k) for k in X.ENTITY})
    assert r.date == ["March 15, 2026", "2026-03-15"] and r.price == ["$1,299.00"] and r.email == ["A.b@x.org"]
    assert r.percentage == ["85%"] and r.number_with_unit == ["40mm"] and r.url == ["https://x.org/a?b."] and "+1-555-123-4567" in r.phone


@pytest.mark.parametrize("query, intent", [("what is the price", "fact"), ("download the report", "task"), ("show me the source", "evidence"), ("visit the pricing page", "navigation"), ("go to the docs", "navigation"), ("open the page and click", "task"), ("download the evidence", "hybrid")])
def test_intents(spark, query, intent):
    p = retrieve.plan(spark, query)
    assert p.intent == intent and p.steps and 0 < p.confidence <= 1


def test_section_paths_relationally(pages):
    b = parse.blocks(pages)
    assert parse.section_paths(b).filter("path <> section_path").count() == 0


def test_bm25_and_index_upserts(spark):
    rows = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta"), (4, ""), (5, None)]
    d = spark.createDataFrame(rows, "key long, text string")
    got = [(r.key, r.score) for r in index.bm25(d, "beta Beta the").collect()]
    n, df, avg = 3, 2, (3 + 2 + 1) / 3
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    want = {1: 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), 2: 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))}
    assert [k for k, _ in got] == [1, 2] and all(s == pytest.approx(want[k]) for k, s in got)
    ix = index.build(d)
    assert [(r.key, pytest.approx(r.score)) for r in index.bm25_indexed(ix, "beta beta").collect()] == got
    changed = index.add(ix, spark.createDataFrame([(2, "alpha"), (9, "beta")], "key long, text string"))
    full = index.build(spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "delta"), (9, "beta")], "key long, text string"))
    for a, b in ((changed.terms, full.terms), (changed.lengths, full.lengths), (changed.stats, full.stats)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert index.remove(ix, spark.createDataFrame([(1,)], "key long")).stats.first().n == 2
    assert index.bm25(d, "the").count() == 0


def test_search_answer_and_evidence(spark, pages, parsed):
    b, a = parsed
    hits = retrieve.search(b, "second unclosed bold", 5)
    top = hits.first()
    assert top.doc_id == "d1" and "Second one" in top.text
    ans = retrieve.answer(hits, "fact").first()
    assert ans.citations and 0 < ans.confidence <= 1
    assert retrieve.answer(hits.limit(0), "fact").first().confidence == 0
    ev = retrieve.evidence(b, a)
    assert ev.count() == b.count() + a.count() and ev.select("evidence_id").distinct().count() == ev.count()
    s = session.Session(spark).ingest(pages)
    assert s.stats().first().documents == 4 and s.search_actions("sign go").count() >= 1 and set(s.publish()) == {"llms.txt", "agent.json", "content.json", "actions.json", "agent-sitemap.xml"}
    s.ingest(pages.limit(1))
    assert s.stats().first().documents == 4


def test_citations(spark):
    a = spark.createDataFrame([(1, "The cat sat. A dog barked loudly.")], "k long, answer string")
    e = spark.createDataFrame([(1, 0, "dog barked loudly", 0.9, "u"), (1, 1, "nothing common", 0.9, "u"), (1, 2, "cat", 0.5, "u")], "k long, idx int, text string, confidence double, url string")
    c = retrieve.cite(a, e, ["k"]).orderBy("rank").collect()
    assert [r.idx for r in c] == [0, 2] and c[0].relevance > c[1].relevance
    assert retrieve.answer_span(a.join(e.filter("idx = 0"), "k"), ["k"]).first().sentence == "A dog barked loudly."
    assert "[1]" in retrieve.render_citations(retrieve.cite(a, e, ["k"]), ["k"]).first().rendered


def test_graph_and_apis(spark, pages, parsed):
    b, a = parsed
    e = graph.nav_edges(a.filter("doc_id = 'd1'"))
    kinds = {r.node_type for r in e.collect()}
    assert kinds == {"page", "form_result", "download"}
    assert graph.nav_nodes(e).count() == e.select("target").distinct().count()
    states, moves = graph.action_graph(pages.select("doc_id", "url", F.lit("t").alias("title")), a)
    assert {r.effect for r in moves.collect()} >= {"navigate", "submit_form", "download"} and states.filter("placeholder").count() > 0
    c = graph.api_candidates(a)
    got = {(r.doc_id, r.method, r.endpoint): r for r in c.collect()}
    assert got["d1", "GET", "/search"].safety == "read_only" and got["d1", "POST", "/in"].mode == "confirm"
    modes = {r.action_id: r.mode for r in graph.decide(a.filter("doc_id = 'd1'"), c).collect()}
    assert set(modes.values()) <= {"api", "confirm", "browser"} and "confirm" in modes.values()
    near = graph.reachable(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "from_state string, to_state string"), spark.createDataFrame([("a",)], "state string"), 2)
    assert sorted(map(tuple, near.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_sites(spark, pages, parsed):
    b, a = parsed
    q = {r.doc_id: r for r in site.quality(b).collect()}
    assert "fewer than 3 blocks" in q["d3"].warnings and q["d1"].parse_confidence > q["d3"].parse_confidence
    kids = parse.body_children(pages).join(pages.select("doc_id", F.col("site_id").alias("domain")), "doc_id")
    kind = {(r.domain, r.key): r.kind for r in site.learn_profiles(kids).collect()}
    assert kind["s.example.com", "header|"] == "header" and kind["s.example.com", "footer|"] == "footer" and kind["s.example.com", "div|cookie-banner"] == "noise"
    assert site.signatures(site.learn_profiles(kids)).count() == 1
    p = spark.createDataFrame([("http://h/", '<a href="/a">x</a><a href="b.pdf">y</a>'), ("http://h/a", '<a href="c">x</a>'), ("http://h/c", '<a href="/d/">x</a>'), ("http://h/d", "")], "url string, html string")
    got = site.crawl(p, spark.createDataFrame([("http://h/",)], "url string"), 2)
    assert sorted(map(tuple, got.collect())) == [("http://h/", 0), ("http://h/a", 1), ("http://h/c", 2)]
    with_labels = site.site_records(pages.withColumn("timestamp", F.lit(1)), a)
    assert {r.site_id: r.doc_count for r in with_labels.collect()} == {"s.example.com": 2, "t.example.com": 2}
    visits = spark.createDataFrame([("d", u, k) for k, u in enumerate("abab")], "domain string, url string, seq int")
    assert [tuple(r) for r in site.url_pairs(visits).select("first", "second", "n").collect()] == [("a", "b", 2)]
    blocks3 = spark.createDataFrame([("d", f"p{k}", "paragraph", t) for k in range(3) for t in ("footer", f"own {k}")], "domain string, doc_id string, type string, text string")
    acts = spark.createDataFrame([("d", f"p{k}", "search") for k in range(2)], "domain string, doc_id string, role string")
    m = site.memory_patterns(blocks3, acts, visits)
    assert [r.text for r in m["template_texts"].collect()] == ["footer"] and m["roles"].first().role == "search"


def test_diffs(spark, parsed):
    schema = "doc_id string, ord int, text string"
    old = spark.createDataFrame([("d", 0, "same"), ("d", 1, "same"), ("d", 2, "a longer text that changes a bit"), ("d", 3, "gone")], schema)
    new = spark.createDataFrame([("d", 0, "same"), ("d", 1, "a longer text that changed a bit"), ("d", 2, "fresh block")], schema)
    got = sorted((r.change, r.old_text, r.new_text) for r in diff.block_changes(old, new).collect() if r.change != "added")
    assert got == [("modified", "a longer text that changes a bit", "a longer text that changed a bit"), ("removed", "gone", None), ("removed", "same", None)]
    _, a = parsed
    assert diff.action_changes(a, a).count() == 0
    assert {r.change for r in diff.action_changes(a, a.filter("type <> 'navigate'")).collect()} == {"removed"}


def test_budget_levels(spark):
    rows = [("d", 0, "heading", "Head", 0.9, ["Head"]), ("d", 1, "paragraph", "One is here. Two is here. " + "Three goes on. " * 30, 0.8, ["Head"])] + [("d", k, "paragraph", f"low block {k} " * 5, 0.1, ["Head"]) for k in range(2, 8)]
    b = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, importance double, section_path array<string>")
    used = {n: {r.level_used for r in budget.compress(b, n).collect()} for n in (1000, 120, 40, 5)}
    assert used[1000] == {0} and used[120] == {1} and used[40] == {5} and used[5] == {6}
    tight = budget.compress(b, 5).collect()
    assert {r.type for r in tight} == {"heading"}
    for n in (1000, 120, 40):
        assert max(1, sum(len(r.text) for r in budget.compress(b, n).collect()) // 4) <= n


def test_markdown_and_formats(parsed, pages):
    b, a = parsed
    md = {r.doc_id: r.markdown for r in budget.markdown(b).collect()}["d1"]
    assert "# Guide" in md and "| Name | Value |" in md and "```python" in md and "> Quoted" in md and "- one" in md
    for style in ("axtree", "xml", "compact", "agent_prompt"):
        assert publish.format_blocks(b, style).count() == 3
    docs = pages.select("doc_id", "site_id", "url", F.lit("T").alias("title"))
    agent = publish.parse_agent_json(publish.agent_json(docs, b, a)).collect()
    assert all(r.spec is not None for r in agent) and publish.function_calls(a, "plain").count() == 2
    skill = publish.skill_markdown(docs, graph.api_candidates(a), a)
    parsed_skill = {r.site_id: r for r in publish.parse_skill(skill).collect()}
    assert "#f" not in parsed_skill["t.example.com"].selectors
    hinted = publish.apply_hints(b, b.sparkSession.createDataFrame([("article",)], "selector string"))
    assert hinted.agg(F.sum("importance")).first()[0] > b.agg(F.sum("importance")).first()[0]
    assert publish.form_guide(a).filter("field = 'query' and required").count() == 2
    assert budget.doc_summary(b).filter("doc_id = 'd1'").first().summary.startswith("Guide | ")
    assert publish.debug_counts(b, a).count() > 5 and publish.chunks(docs, b).count() == b.count() and publish.chat_messages(budget.markdown(b)).count() == 3


def test_json_source(spark):
    title, blocks = readers.walk_json({"title": "T", "n": 3, "ok": True, "rows": [{"a": 1}, {"b": [2]}], "tags": ["x", "y"], "next": "/p2", "none": None, "deep": {"k": "v"}})
    assert title == "T" and [b["type"] for b in blocks] == ["heading", "paragraph", "heading", "metadata", "heading", "metadata", "heading", "table", "heading", "list", "heading", "heading", "paragraph"]
    assert blocks[-1]["section_path"] == ["deep", "k"]
    d = spark.createDataFrame([("a", '{"next_url": "/2", "x": [1, "s"]}'), ("b", "no json"), ("c", None)], "doc_id string, json string")
    assert readers.json_blocks(d).count() == 3
    assert [tuple(r) for r in readers.json_pagination(d).select("role", "target_url").collect()] == [("next_page", "/2")]
    assert readers.detect_encoding("text/html; charset=ISO-8859-1", b"") == "iso-8859-1" and readers.detect_encoding(None, b'<meta charset="koi8-r">') == "koi8-r" and readers.detect_encoding(None, b"\xff\xfea") == "utf-16-le"
    kinds = [r.kind for r in readers.route(spark.createDataFrame([("[1]",), ("<p>x",), ("plain",), ("\x01\x02",)], "html string")).collect()]
    assert kinds == ["json", "html", "text", "binary"]
    with pytest.raises(KeyError):
        readers.resolve_fetcher("nowhere")


def test_builder_and_plugins(pages):
    b = session.PipelineBuilder().on("after:segment", lambda d: d.filter("type = 'heading'")).with_stage("count", lambda d: d.groupBy("doc_id").count())
    assert b.build()(pages).count() == 2
    assert "type" in b.skip("count").build()(pages).columns
    r = session.PluginRegistry()
    r.register("p", object(), ("source",))
    assert r.discover("source") == ["p"] and r.get("q") is None
    with pytest.raises(ValueError):
        r.register("p", object())


def test_streams_equal_batches(spark, pages, parsed, tmp_path):
    src = str(tmp_path / "pages")
    pages.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.block_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == parse.blocks(pages).count()
    texts = spark.createDataFrame([("1", "alpha beta"), ("2", "beta")], "key string, text string")
    texts.coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("2", "gamma"), ("3", "alpha")], "key string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    s = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    streams.upsert_index(s, str(tmp_path / "ix"), str(tmp_path / "c2")).awaitTermination(120)
    assert index.Index.read(spark, str(tmp_path / "ix/v1")).stats.first().n == 3
    b, a = parsed
    ev = [r.event for r in streams.events(b.filter("doc_id = 'd1'"), a.filter("doc_id = 'd1'"), 20).orderBy("seq").collect()]
    assert ev[0] == "progress" and ev[-1] == "complete" and "budget_reached" in ev and ev.index("budget_reached") < ev.index("action")


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, str, list)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{float(v):.5f}"


def connection(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def same(spark, sf, con, fn, sql):
    df = fn(spark, sf)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, connection(sf), catalog.queries()[name], catalog.oracle_sql()[name])


def test_reachable_states_use_every_line(spark, tmp_path):
    spark.createDataFrame([(1, 9), (2, 9), (2, 7), (3, 7), (4, 1)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in catalog.queries()["reachable_states"](spark, str(tmp_path)).select("state", "hops").collect()}
    assert got == {(1, 0), (-9, 1), (2, 2)}


def _texts(spark, sf, tmp_path):
    """Documents and some odd ones: letters beyond ASCII next to words and numbers, dates, phones."""
    odd = ["Straße Größe 1999 Émile März", "née May5 Mai 2020ä äMay", "On March 15, 2026 or 15/03/2026 call +1-555-123-4567 für 30 days", "", None]
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d.unionByName(spark.createDataFrame(list(enumerate(odd, 10_000_000)), "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}


def test_salience_features_against_python(spark, sf, tmp_path):
    texts = _texts(spark, sf, tmp_path)
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    got = {r.doc_id: (r.length_score, r.density) for r in catalog.queries()["salience_features"](spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys() and sum(not (x or "").isascii() for x in texts.values()) > 70
    for d, x in texts.items():
        if x is None:
            assert got[d] == (None, None)
            continue
        n = len(re.findall(r"\d+", x)) + len(re.findall(rf"(?i)\b(?:19[0-9][0-9]|20[0-9][0-9]|{months})\b", x)) + len(re.findall(r"\b[A-Z][a-z][a-z]+\b", x))
        want = (1 / (1 + math.exp(-(len(x) - 100) / 50)) if len(x) < 30_000 else 1, 2 / (1 + math.exp(-100 * n / len(x))) - 1 if x else 0)
        assert got[d] == pytest.approx(want, abs=2e-6), (d, x[:80])


def test_entity_counts_against_python(spark, sf, tmp_path):
    texts = _texts(spark, sf, tmp_path)
    got = {(r.doc_id, r.kind): (r.n, r.least) for r in catalog.queries()["entity_counts"](spark, str(tmp_path)).collect()}
    want = {}
    for d, x in texts.items():
        for kind, patterns in X.ENTITY.items():
            found = [m.group() for p in patterns for m in re.finditer(p, x or "")]
            if found:
                want[d, kind] = (len(found), min(found))
    assert {"date", "phone"} <= {k for _, k in got} and got == want


def test_equal_pages_stay_on_every_site(spark, tmp_path):
    form = "<html><title>T</title><body><h1>Head</h1><p>Some words of text.</p><form method='post'><input name='q' required><button>Send</button></form><a href='https://c.example.com/x'>to x</a></body></html>"
    rows = [(1, "https://b.example.com/2", form), (2, "https://a.example.com/1", form), (3, "https://a.example.com/3", form), (4, "https://c.example.com/x", "<h1>Other</h1><p>line of words</p>"), (5, "https://d.example.com/x", "<h1>Other</h1><p>line of words</p>")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    t.write.parquet(f"{tmp_path}/pages.parquet")
    q = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("site_sitemap", "site_llms_txt", "site_agent_json", "site_content_json", "site_actions_json", "page_api_candidates", "page_blocks", "page_action_graph", "page_decisions")}
    for n in ("site_sitemap", "site_llms_txt", "site_agent_json", "site_content_json"):
        text = {r.site_id: str(r) for r in q[n]}
        assert all(text[u.split("/")[2]].count(u) == 1 for _, u, _ in rows), n
    assert {r.site_id for r in q["site_actions_json"]} == {"a.example.com", "b.example.com"}
    assert {r.endpoint for r in q["page_api_candidates"] if r.method == "POST"} == {u for _, u, h in rows if h == form}
    for n, key in (("page_blocks", "block_id"), ("page_decisions", "action_id")):
        keys = [(r.doc_id, r[key]) for r in q[n]]
        assert keys and len(keys) == len(set(keys)), n
    assert len(q["page_action_graph"]) == len({(r.from_state, r.action_id) for r in q["page_action_graph"]})

    pages = t.select(X.doc_id("html").alias("doc_id"), X.site_id("url").alias("site_id"), "url", "html")
    s = session.Session(spark).ingest(pages.filter("page_id <> 2")).ingest(pages.filter("page_id in (2, 3)"))
    assert sorted(r.url for r in s.pages.collect()) == sorted(u for _, u, _ in rows)
    assert {r.url for r in s.blocks.select("url").distinct().collect()} == {"https://a.example.com/1", "https://c.example.com/x"}
    assert {r.site_id for r in s.publish()["agent-sitemap.xml"].collect()} == {"a.example.com", "b.example.com", "c.example.com", "d.example.com"}
    changed = pages.filter("page_id = 1").withColumn("html", F.lit("<p>new</p>"))
    assert [r.html for r in s.ingest(changed).pages.join(changed.select("doc_id"), "doc_id").collect()] == ["<p>new</p>"]


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
