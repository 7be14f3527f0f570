"""Relevance, plans, alignment, provenance, measures, sinks and one-pass parsing, on small rows against plain Python."""

import json
import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomstead.operators import align, evaluate, graph, parse, provenance, publish, relevance, retrieve, site
from loomstead.plans import session
from loomstead.sources import sinks

from .test_dom import PAGE

BLOCKS = [
    ("d1", "b0", 0, "heading", "Pricing plans", 1, ["Pricing"], 0.9), ("d1", "b1", 1, "paragraph", "The price of the pro plan is $10 a month.", None, ["Pricing"], 0.7), ("d1", "b2", 2, "paragraph", "Unrelated words about weather and rain.", None, [], 0.4),
    ("d1", "b3", 3, "paragraph", "", None, [], 0.5), ("d1", "b4", 4, "table", "plan price free 0 pro 10", None, ["Pricing", "Table"], 0.8), ("d2", "b0", 0, "paragraph", "Another page with a price.", None, [], 0.6),
]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(*b, "html > body > main", b[7], f"https://x.example.com/{b[0]}", "x.example.com", "{}") for b in BLOCKS]
    return spark.createDataFrame(rows, "doc_id string, block_id string, ord int, type string, text string, level int, section_path array<string>, importance double, dom_path string, evidence_score double, url string, site_id string, meta string")


def plain_relevance(doc, query):
    words = re.findall("[a-z0-9]+", query.lower())
    tok = {b[1]: re.findall("[a-z0-9]+", b[4].lower()) for b in doc}
    df = {w: sum(w in t for t in tok.values()) for w in words}
    heads = [b[2] for b in doc if b[3] == "heading" and set(tok[b[1]]) & set(words)]
    out = {}
    for b in doc:
        t = tok[b[1]]
        raw = sum(t.count(w) / len(t) * math.log(1 + len(doc) / (1 + df[w])) for w in words) / len(words) if t else 0
        tfidf = min(1.0, 2 / (1 + math.exp(-5 * raw)) - 1) if t else 0
        path = re.findall("[a-z0-9]+", " ".join(b[6]).lower())
        near = 1 / (1 + min(abs(b[2] - h) for h in heads)) if heads else 0
        r = min(1.0, 0.6 * tfidf + 0.2 * sum(w in path for w in words) / len(words) + 0.2 * near)
        if r >= 0.1:
            out[b[0], b[1]] = (r, b[7] * 0.5 + r * 0.5)
    return out


@pytest.mark.parametrize("query", ["pricing price", "price price plan", "weather", "nothing here"])
def test_query_filter_against_plain_python(blocks, query):
    want = {}
    for d in ("d1", "d2"):
        want |= plain_relevance([b for b in BLOCKS if b[0] == d], query)
    got = {(r.doc_id, r.block_id): r for r in relevance.query_filter(blocks, query).collect()}
    assert got.keys() == want.keys()
    for k, (rel, imp) in want.items():
        assert got[k].relevance == pytest.approx(rel, abs=1e-12) and got[k].importance == pytest.approx(imp, abs=1e-12)
    kept = relevance.query_filter(blocks, query, max_blocks=1).collect()
    assert len(kept) == len({d for d, _ in want})


def test_query_filter_edges(blocks):
    assert relevance.query_filter(blocks, "?!").count() == len(BLOCKS)
    with pytest.raises(ValueError):
        relevance.query_filter(blocks, "  ")
    assert relevance.query_filter(blocks.limit(0), "price").count() == 0


def test_retrieval_by_plan(spark, blocks):
    actions = spark.createDataFrame([("d1", "a1", 0, "submit", "Search prices", "search", 0.9), ("d1", "a2", 1, "navigate", "Go to pricing", None, 0.8)], "doc_id string, action_id string, ord int, type string, label string, role string, confidence double")
    got = relevance.by_plan(blocks, actions, "show me the source of the price", 10).collect()
    assert got and all(r.kind == "block" for r in got) and {r.id for r in got} <= {"b0", "b1", "b4"}  # evidence: importance of 0.7 or more
    nav = relevance.by_plan(blocks, actions, "visit the pricing page", 10).collect()
    assert [(r.kind, r.id) for r in nav] == [("action", "a2")]
    both = relevance.by_plan(blocks, actions, "price pricing", 10, plan=retrieve.Plan("", "hybrid", [retrieve.Step("search_blocks"), retrieve.Step("search_actions"), retrieve.Step("execute_action")], "", 1.0)).collect()
    assert {r.kind for r in both} == {"block", "action"} and [r.score for r in both] == sorted((r.score for r in both), reverse=True)


def test_char_ranges(spark):
    rows = [("d", "<p>hello world</p>", "hello world"), ("d", "<p>a long enough start of it</p>", "a long enough start of it"), ("e", "<p>abc</p>", ""), ("e", "<p>abc</p>", "xyz"), ("e", None, "abc")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id string, html string, text string")
    got = [r.c for r in df.select("i", align.char_range(F.col("text"), F.col("html")).alias("c")).orderBy("i").collect()]
    assert [tuple(c) if c else None for c in got] == [(3, 14), (3, 28), None, None, None]
    long = "x" * 75 + " tail " + "y" * 40
    r = spark.createDataFrame([("<p>" + long[:80] + "</p>", long)], "html string, text string").select(align.char_range(F.col("text"), F.col("html")).alias("c")).first().c
    assert tuple(r) == (3, 3 + len(long[:80].strip()))


def test_ax_tree_and_boxes(spark, blocks):
    tree = {"role": "root", "children": [{"role": "heading", "name": "Pricing plans", "bbox": [1, 2, 3, 4]}, {"role": "text", "name": "Unrelated words"}, {"name": "the price", "children": [{"role": "cell", "name": "zzz"}]}]}
    nodes = align.flatten_ax(spark.createDataFrame([("d1", json.dumps(tree)), ("d2", "{not json"), ("d3", None), ("d4", "{}")], "doc_id string, tree string"))
    assert [(r.doc_id, r.ord, r.role, r.name) for r in nodes.orderBy("ord").collect()] == [("d1", 0, "root", ""), ("d1", 1, "heading", "Pricing plans"), ("d1", 2, "text", "Unrelated words"), ("d1", 3, "unknown", "the price"), ("d1", 4, "cell", "zzz")]
    got = {(r.doc_id, r.block_id): (r.ax_role, r.ax_bbox) for r in align.with_ax(blocks, nodes).collect()}
    assert len(got) == len(BLOCKS) and got["d1", "b0"] == ("heading", [1.0, 2.0, 3.0, 4.0]) and got["d1", "b2"] == ("text", None) and got["d1", "b1"][0] == "unknown" and got["d2", "b0"] == (None, None)
    p = spark.createDataFrame([("d1", "html > body > main", [1.0, 2.0, 10.0, 20.0]), ("d2", "html > body > main", [1.0])], "doc_id string, selector string, bbox array<double>")
    boxes = {(r.doc_id, r.block_id): (r.region_id, r.box) for r in align.with_boxes(blocks, p, "block", "block_id", F.col("dom_path")).collect()}
    assert boxes["d1", "b0"][1] == [1.0, 2.0, 11.0, 22.0] and boxes["d1", "b0"][0].startswith("r_") and boxes["d2", "b0"] == (None, None)


def test_document_rows(spark, blocks):
    pages = spark.createDataFrame([("d1", "s", "u1", "<title> </title>"), ("d2", "s", "u2", "<TITLE a='b'> Two </title>"), ("d9", "s", "u9", "<p>x")], "doc_id string, site_id string, url string, html string")
    got = {r.doc_id: r for r in provenance.document_rows(pages, blocks).collect()}
    assert (got["d1"].title, got["d2"].title, got["d9"].title) == ("Pricing plans", "Two", "")
    assert got["d1"].entity_summary == ["$10"] and (got["d1"].block_count, got["d9"].block_count) == (5, 0)
    assert got["d1"].summary.startswith("Pricing plans | The price") and got["d9"].summary == ""
    index = {(r.doc_id, r.section): r.block_ids for r in provenance.section_index(blocks).collect()}
    assert index == {("d1", "Pricing"): ["b0", "b1"], ("d1", "(root)"): ["b2", "b3"], ("d1", "Pricing > Table"): ["b4"], ("d2", "(root)"): ["b0"]}


def test_answer_with_provenance(spark, blocks):
    docs = spark.createDataFrame([("d1", "https://x.example.com/d1", "# text", "t"), ("d2", "https://x.example.com/d2", None, "title two")], "doc_id string, url string, markdown string, title string")
    snaps = provenance.capture(docs, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    later = provenance.capture(docs.withColumn("markdown", F.lit("new")), F.lit("2024-01-02 00:00:00").cast("timestamp"))
    every = snaps.unionByName(later)
    assert [(r.version, r.changed) for r in provenance.history(every).filter("doc_id = 'd1'").orderBy("version").collect()] == [(1, True), (2, True)]
    out = provenance.answer_with_provenance(blocks, blocks.limit(0), "price of the pro plan", every)
    assert "price" in out["answer"].lower() and "[1]" in out["cited_answer"] and out["citations"].count() >= 1
    assert [s[0] for s in out["trace"].steps] == ["search", "retrieve", "evidence", "cite"] and out["trace"].rows(spark).count() == 4
    assert "## Answer" in out["trace"].markdown()
    assert {r.snapshot_id for r in out["snapshot_ids"].collect()} <= {r.snapshot_id for r in later.collect()}
    none = provenance.answer_with_provenance(blocks, blocks.limit(0), "zzzz qqqq")
    assert none["confidence"] == 0.0 and none["citations"].count() == 0 and none["cited_answer"] == none["answer"]


def test_measures(spark, blocks):
    expected = spark.createDataFrame([("d1", ["pricing"], 1, 0, ["weather", "absent"]), ("d7", ["x"], 1, 1, [])], "doc_id string, headings array<string>, tables int, codes int, phrases array<string>")
    got = {r.doc_id: tuple(r)[1:] for r in evaluate.fidelity(blocks, expected).collect()}
    assert got["d1"] == (1.0, 1.0, 1.0, 0.5, 1.0) and got["d7"] == (0.0, 0.0, 0.0, 1.0, 0.0)
    results = spark.createDataFrame([(1, 1, "no"), (1, 2, "the Price here"), (2, 1, "x")], "query_id int, rank int, text string")
    items = spark.createDataFrame([(1, ["price"]), (2, ["price"]), (3, ["y"])], "query_id int, keywords array<string>")
    assert sorted(map(tuple, evaluate.search_quality(results, items, (1, 2)).collect())) == [(1, 0.0, 1.0, 0.5), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]
    found = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b")], "doc_id string, label string")
    want = spark.createDataFrame([("d", "a"), ("d", "c"), ("e", "a")], "doc_id string, label string")
    pr = {r.doc_id: (round(r.precision, 3), round(r.recall, 3)) for r in evaluate.precision_recall(found, want, ["label"]).collect()}
    assert pr == {"d": (0.333, 0.5), "e": (0.0, 0.0)}
    e = spark.range(1).select(evaluate.token_efficiency(F.lit("a b c d e f g h i j"), F.lit("a b c d e")).alias("e"), evaluate.token_efficiency(F.lit("a"), F.lit("")).alias("z")).first()
    assert tuple(e.e) == (13, 6, 2.17) and e.z.compression is None


def test_call_specs(spark):
    c = spark.createDataFrame([("https://h/a?x=1", "GET", ["q", "empty"]), ("https://h/b", "POST", ["q"]), ("https://h/c", "GET", [])], "endpoint string, method string, params array<string>")
    got = {r.endpoint: (r.call_url, r.body) for r in graph.call_specs(c, F.create_map(F.lit("q"), F.lit("a b&c"))).collect()}
    assert got == {"https://h/a?x=1": ("https://h/a?x=1&q=a+b%26c", None), "https://h/b": ("https://h/b", {"q": "a b&c"}), "https://h/c": ("https://h/c", None)}


def test_pages_are_parsed_once(spark, monkeypatch):
    pages = spark.createDataFrame([("d1", "s", "u", PAGE), ("d2", "s", "v", None)], "doc_id string, site_id string, url string, html string")
    p = parse.once(pages, ("blocks", "actions", "assets", "children"))
    for one, name in ((parse.blocks, "blocks"), (parse.actions, "actions"), (parse.assets, "assets"), (parse.body_children, "children")):
        a, b = one(p), one(pages)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    docs = pages.select("doc_id", "site_id", "url", F.lit("t").alias("title"))
    out = publish.agent_json(docs, parse.blocks(p), parse.actions(p))
    plan = out._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and plan.replace("InMemoryRelation", "").count("MapInArrow") == plan.count("InMemoryRelation")  # inside the kept rows alone
    p.unpersist()


def test_profiles_are_learnt_and_applied(spark):
    page = "<html><body><div class='site-header'>Logo and a menu for all</div><div class='text'><p>{} is the content of this page, with words enough.</p></div></body></html>"
    pages = spark.createDataFrame([(f"d{k}", "h", page.format(f"Number {k}")) for k in range(4)] + [("x", "other", page.format("Other"))], "doc_id string, domain string, html string")
    learnt = site.learn_profiles(parse.body_children(pages).join(pages.select("doc_id", "domain"), "doc_id"))
    assert {r.key: r.kind for r in learnt.filter("domain = 'h'").collect()} == {"div|site-header": "header", "div|text": "main"}
    blocks = parse.profiled_blocks(pages, learnt)
    assert all("Logo" not in r.text for r in blocks.filter("doc_id like 'd%'").collect()) and blocks.select("doc_id").distinct().count() == 5
    back = sinks.read_profiles(sinks.profile_json(learnt))
    assert {(r.domain, r.kind, r.key) for r in back.collect()} == {(r.domain, r.kind, r.key) for r in learnt.filter("kind is not null").collect()}


def test_sinks(spark, blocks, tmp_path):
    sites = {"llms.txt": spark.createDataFrame([("www.a.com", "one\ntwo"), ("b.org", "three")], "site_id string, content string"), "agent.json": spark.createDataFrame([("www.a.com", "{}")], "site_id string, spec string")}
    sinks.write_site_files(sites, str(tmp_path / "site"))
    back = {(r.site, r.name): r.t for r in spark.read.text(str(tmp_path / "site"), wholetext=True).groupBy("site", "name").agg(F.max("value").alias("t")).collect()}
    assert {k: v.strip() for k, v in back.items()} == {("a", "llms.txt"): "one\ntwo", ("b", "llms.txt"): "three", ("a", "agent.json"): "{}"}
    b = blocks.withColumn("domain", F.col("site_id"))
    a = spark.createDataFrame([("x.example.com", "d1", "search")], "domain string, doc_id string, role string")
    v = spark.createDataFrame([("x.example.com", "u", 1)], "domain string, url string, seq int")
    m = site.memory_patterns(b, a, v, min_pages=2)
    sinks.write_memory(m, str(tmp_path / "memory"))
    assert sinks.read_memory(spark, str(tmp_path / "memory"), {"top_types": "domain string, type string, n long, rank int"})["top_types"].count() == m["top_types"].count() > 0


def test_cache(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "<p>a</p>"), ("d2", "<p>b</p>")], "doc_id string, html string")
    compile_ = lambda d: d.withColumn("compiled", F.upper("html"))
    at = lambda s: F.lit(datetime.fromisoformat(s)).cast("timestamp")
    empty = spark.createDataFrame([], sinks.CACHE)
    done, fresh = sinks.compile_cached(docs, empty, "c1", compile_, at("2024-01-01 00:00:00"), 100)
    assert {(r.doc_id, r.compiled, r.cached) for r in done.collect()} == {("d1", "<P>A</P>", False), ("d2", "<P>B</P>", False)}
    sinks.write_cache(fresh, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    changed = docs.withColumn("html", F.when(F.col("doc_id") == "d2", "<p>new</p>").otherwise(F.col("html")))
    done, _ = sinks.compile_cached(changed, cache, "c1", compile_, at("2024-01-01 00:01:00"), 100)
    assert {(r.doc_id, r.cached) for r in done.collect()} == {("d1", True), ("d2", False)}
    for config, when in (("c2", "2024-01-01 00:01:00"), ("c1", "2024-01-01 01:00:00")):
        assert not any(r.cached for r in sinks.compile_cached(docs, cache, config, compile_, at(when), 100)[0].collect())


def test_hints_have_a_stated_bound(spark, blocks, monkeypatch):
    hints = spark.createDataFrame([("body main",), (".none",), ("",)], "selector string")
    assert [round(r.importance, 2) for r in publish.apply_hints(blocks, hints).orderBy("doc_id", "ord").collect()] == [1.0, 0.95, 0.65, 0.75, 1.0, 0.85]
    assert publish.apply_hints(blocks, hints.limit(0)).select("importance").collect() == blocks.select("importance").collect()
    monkeypatch.setattr(publish, "MAX_HINTS", 1)
    with pytest.raises(ValueError):
        publish.apply_hints(blocks, hints)


def test_builder_setters_and_embedder(spark):
    pages = spark.createDataFrame([("d1", PAGE)], "doc_id string, html string")
    seen = []
    run = session.PipelineBuilder().with_normalizer(lambda d: d.withColumn("html", F.replace("html", F.lit("Guide"), F.lit("Manual")))).with_extractor(lambda d: d.filter("type = 'heading'")).with_validator(lambda d: seen.append(d.columns)).build()
    assert "Manual" in {r.text for r in run(pages).collect()} and seen and "text" in seen[0]
    docs = spark.createDataFrame([(1, "a bb"), (2, None), (3, "ccc")], "key long, text string")
    got = {r.key: r.embedding for r in session.embed(docs, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [4.0, 1.0], 2: None, 3: [3.0, 1.0]}


def test_entities_are_those_of_the_sql(spark, tmp_path):
    """Texts put together at random from what entities are made of and from what engines read differently: letters beyond ASCII, odd spaces, long s."""
    import random

    import duckdb

    from loomstead.plans import catalog

    bits = "é ü я 日 ſ K \u000b \t \n . - _ @ + ( ) % , : / € $ 12 2024 2024-01-02 1/2/2024 5kmé é5km 5 km 90% é90% Augu ſt August Sep 3 a.b c@d.eu c@d.euß x@é.com http://a.b/c é@a.bc 555 1234 +49 µ".split(" ") + [" ", " ", " ", " "]
    rnd = random.Random(7)
    rows = [(k, "".join(rnd.choice(bits) for _ in range(30))) for k in range(3000)] + [(3000, "Auguſt 3, 2024"), (3001, "ünder 5 kmß"), (3002, "é2024-01-02"), (3003, "a@" + "b." * 20000 + "com")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["entity_counts"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(catalog.oracle_sql()["entity_counts"]).fetchall()) and len(got) > 3000


def test_delta_feed_compares_each_pair_at_a_url(spark, tmp_path):
    """Several old and new pages at one URL: each pair is a row, and only where the two differ."""
    import duckdb

    from loomstead.plans import catalog

    spark.createDataFrame([(2, "u", "x"), (3, "u", "y"), (5, "v", "x"), (6, "w", "z"), (10, "u", "x"), (11, "u", "y"), (8, "n", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.queries()["delta_feed"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.sql(catalog.oracle_sql()["delta_feed"]).fetchall())


def test_indexed_scores_do_not_depend_on_the_order_of_postings(spark):
    """Equal blocks have equal scores, whatever order their postings come in; else their ties aren't left to the key."""
    import itertools

    from loomstead.operators import index

    words = ["aa", "bb", "cc", "dd"]
    orders = list(itertools.permutations(range(4)))
    p = spark.createDataFrame([(k, words[i], i + 1) for k, o in enumerate(orders) for i in o], "key long, term string, tf long").coalesce(1)
    terms = spark.createDataFrame([(w, 3 + 7 * i) for i, w in enumerate(words)], "term string, df long")
    lengths = spark.createDataFrame([(k, 10) for k in range(len(orders))], "key long, dl long")
    ix = index.Index(p, terms, lengths, spark.createDataFrame([(97, 11.3)], "n long, avgdl double"))
    hits = index.bm25_indexed(ix, "aa bb cc dd dd", 100).collect()
    assert [h.key for h in hits] == list(range(24)) and len({h.score for h in hits}) == 1
    near = index.Index(p.filter("key < 2"), terms, spark.createDataFrame([(0, 10), (1, 10)], "key long, dl long"), ix.stats)
    assert [h.score for h in index.bm25_indexed(near, "aa bb", 100, digits=3).collect()] == [round(hits_.score, 3) for hits_ in index.bm25_indexed(near, "aa bb", 100).collect()]


def test_reachable_keeps_no_table_of_all_transitions(spark):
    """Repeated transitions, and a plan in which none but those out of the front are made distinct."""
    from loomstead.operators import graph

    t = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y"), ("a", None)], "from_state string, to_state string")
    got = graph.reachable(t, spark.createDataFrame([("a",), ("a",)], "state string"), 2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 0), ("b", 1), (None, 1), ("c", 2)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "from_state" in x and "to_state" in x]


def test_tokens_are_counted_where_a_key_lies(spark):
    """Keywords send texts once, not tokens twice; lengths explode nothing; rows that share a key count together."""
    from loomstead.operators import index

    d = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc bb"), (2, "the a"), (3, None), (4, "dd")], "key long, text string")
    k = index.keywords(d, 2)
    assert k._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, k.collect())) == [(1, 1, "bb", 3), (1, 2, "aa", 2), (4, 1, "dd", 1)]
    ix = index.build(d)
    assert "Generate" not in ix.stats._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(ix.stats.first()) == (2, 3.5) and sorted(map(tuple, ix.lengths.collect())) == [(1, 6), (4, 1)]
    assert sorted(map(tuple, index.add(ix, spark.createDataFrame([(4, "aa")], "key long, text string")).terms.collect())) == [("aa", 2, 3), ("bb", 1, 3), ("cc", 1, 1)]


def test_tokens_are_counted_in_small_parts(spark, tmp_path):
    """A task's memory is many times its part of the texts in storage: no part is to be of more than about 2 MB."""
    from loomstead.operators import index

    spark.range(0, 400_000, 1, 4).select(F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/d.parquet")
    stored = sum(x.stat().st_size for x in (tmp_path / "d.parquet").glob("*.parquet"))
    assert index.by_key(spark.read.parquet(f"{tmp_path}/d.parquet")).rdd.getNumPartitions() >= stored / 2.2e6 > 5


def test_salience_counts_whole_words_in_one_pass(spark, tmp_path):
    import duckdb

    from loomstead.plans import catalog

    texts = ["Auguſt MAY 2024 x2024 2024é Bob Bobé éBob Bo B_b", "", "  ", "March\u000bMarch http://a b", "December1 december 1999 12 Ünder Über Abc", "http://a\u000bb http://c"]
    spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["salience_features"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == [pytest.approx(r) for r in sorted(con.sql(catalog.oracle_sql()["salience_features"]).fetchall())]


def test_fuzzy_diff_compares_only_what_may_be_similar(monkeypatch):
    import random

    from loomstead.operators import diff

    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 12)))
    old, new = [[text() for _ in range(60)] for _ in range(2)]
    rows = [{"side": s, "text": x, "old_ord": k if s == "old" else None, "new_ord": k if s == "new" else None} for s, xs in (("old", old), ("new", new)) for k, x in enumerate(xs)]
    want, left = [], dict(enumerate(new))
    for o in old:
        scores = {k: diff.similarity(o, n) for k, n in left.items()}
        at = max((k for k in scores if scores[k] >= 0.7), key=lambda k: (scores[k], -k), default=None)
        want.append(("d", "removed", o, None, None) if at is None else ("d", "modified", o, left[at], scores[at]))
        left.pop(at, None)
    made = []
    monkeypatch.setattr(diff, "SequenceMatcher", lambda *a, real=diff.SequenceMatcher: made.append(1) or real(*a))
    assert diff._greedy("d", rows, 0.7) == want + [("d", "added", None, n, None) for n in left.values()]
    assert len(made) <= len(new)


def test_page_titles_are_those_of_the_sql(spark, tmp_path):
    """Titles are of a page's source: references, tags inside, several titles, blank first headings, ids that repeat, null pages."""
    import duckdb

    from loomstead.plans import catalog

    pages = [
        "<h1>a &amp;lt; b &#x27;c&#39; &Eacute; &quo</h1>", "<h1>a <b>bold</b></h1>", "<title>One</title><p><svg><title>Two</title></svg><h1>Three</h1>", "<h1> </h1><h1>Second</h1>", "<h2>Only</h2>", "<!-- <h1>Said</h1> --><h1>Seen</h1>",
        "<title\u00e9>No</title><h1>Yes</h1>", "<TITLE>Open</TITLE\u000b><h1>Next</h1>", "<title> </title><h1 hidden>Hid</h1>", "<title>Un", "", None,
    ]
    rows = [(2 * k + odd, x) for k, x in enumerate(pages) for odd in (0, 1)] + [(2, "<h1>Again</h1>"), (2, "<h1>Aside</h1>"), (None, "<title>T</title><h1>H</h1>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["page_titles"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(catalog.oracle_sql()["page_titles"]).fetchall(), key=str)
