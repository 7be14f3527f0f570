"""The tree and what is read off it, on markup that the supplied pages lack."""

from loomstead.functions import dom

PAGE = """<html><head><title>T</title><script>var x = "</p>";</script><style>p{}</style></head><body>
<header><nav><a href="/home">Home</a><a href="/docs">Docs</a><a href="/x">X</a></nav></header>
<div class="cookie-banner"><button>Accept</button></div>
<main><article><h1>Guide</h1><p>First paragraph with enough words to be kept as content of the page.
<p>Second one, unclosed, with <b>bold text that is never closed.
<h2>Table</h2><table><thead><tr><th>Name</th><th colspan="2">Value</th></tr></thead><tbody><tr><td>a<td>1<td>2</tr><tr><td>b</td><td>3</td><td colspan="x">4</td></tr></tbody></table>
<h2>Lists</h2><ul><li>one<li>two<ul><li>nested</ul></ul><dl><dt>Term<dd>meaning</dl>
<h3>Code</h3><pre class="language-python"><code>print(1)
print(2)</code></pre><blockquote>Quoted</blockquote>
<figure><img src="a.png" alt="Alt"><figcaption>Caption</figcaption></figure><details><summary>Q</summary>A</details>
<div hidden><p>secret</p></div><p style="display: none">also secret</p><p aria-hidden="true">third</p>
<h2>Forms</h2><form action="/search"><label for="f">Query</label><input id="f" name="query"><select name="kind" aria-label="Kind"><option>a</select><input type="submit" value="Go"></form>
<form action="/in"><input name="user" placeholder="User"><input type="password" name="pw" placeholder="Secret"><input type="hidden" name="t" value="1"><button>Sign</button></form>
<a href="/f.pdf" download>Get file</a><a href="/p/2">Next page</a></article></main><footer>foot</footer></body></html>"""


def test_tree_closes_what_is_left_open():
    root = dom.parse("<p>a<p>b<ul><li>c<li>d</ul><div>e</p></div>")
    assert [n.tag for n in root.elements] == ["p", "p", "ul", "div"]
    assert [dom.squeeze(n.text()) for n in root.walk() if n.tag == "li"] == ["c", "d"]
    assert dom.parse("").elements == [] and dom.parse(None).elements == []
    assert dom.squeeze(dom.parse("<div>" * 3000 + "x").text()) == "x"


def test_blocks_and_sections():
    b = dom.blocks(dom.normalize(dom.parse(PAGE)))
    kinds = [x["type"] for x in b]
    assert kinds[0] == "heading" and not {"nav", "script"} & set(kinds)
    assert not any("secret" in x["text"] or x["text"] == "third" for x in b)
    table = next(x for x in b if x["type"] == "table")
    assert table["meta"] == {"headers": ["Name", "Value"], "rows": [["a", "1", "2"], ["b", "3", "4"]], "row_count": 3, "col_count": 3}
    assert table["section_path"] == ["Guide", "Table"]
    lists = [x for x in b if x["type"] == "list"]
    assert lists[0]["meta"]["items"] == ["one", "two"] and lists[1]["text"] == "Term: meaning"
    code = [x for x in b if x["type"] == "code"]
    assert len(code) == 1 and code[0]["meta"]["language"] == "python" and code[0]["section_path"] == ["Guide", "Lists", "Code"]
    assert [x["text"] for x in b if x["type"] == "figure_caption"] == ["Caption"] and any(x["type"] == "faq" for x in b)


def test_actions_and_forms():
    acts = dom.actions(dom.parse(PAGE))
    by = {a["label"]: a for a in acts}
    go = by["Go"]
    assert go["type"] == "submit" and go["role"] == "submit_search" and go["target_url"] == "/search"
    assert go["value_schema"] == {"query": "text", "kind": "select"} and go["required_fields"] == ["query", "kind"]
    sign = by["Sign"]
    assert sign["type"] == "submit" and sign["value_schema"] == {"user": "text", "pw": "password"}
    assert by["Get file"]["type"] == "download" and by["Get file"]["may_download"]
    assert by["Next page"]["role"] == "next_page" and by["Next page"]["priority"] == 0.6 and by["Home"]["priority"] == 0.3
    assert [a["priority"] for a in acts] == sorted((a["priority"] for a in acts), reverse=True)
    assert len({a["selector"] for a in acts}) == len(acts)


def test_assets_and_structure():
    root = dom.parse(PAGE + '<link rel="stylesheet" href="s.css"><script src="j.js"></script>')
    assert [(a["type"], a["url"]) for a in dom.assets(root)] == [("image", "a.png"), ("stylesheet", "s.css"), ("script", "j.js")]
    assert [c["tag"] for c in dom.body_children(dom.parse(PAGE))] == ["header", "div", "main", "footer"]
    assert "secret" in dom.visible_text(PAGE) and "var x" not in dom.visible_text(PAGE)


def test_blocks_are_of_the_whole_page(spark):
    """Parsing stopped after 2 MB; what costs by pairs of siblings would take hours here."""
    from loomstead.operators import parse

    many = "<html><body><h1>Start</h1>" + "<div class='ad-box'></div>" * 30_000 + "<p>some words of a paragraph</p>" * 60_000 + "<h1>End</h1></body></html>"
    assert len(many) > 2 * 1024 * 1024
    p = spark.createDataFrame([("d", many)], "doc_id string, html string")
    for b in (parse.blocks(p, clean=False), parse.blocks(p), parse.blocks(parse.once(p, ("actions", "blocks")))):
        assert [r.text for r in b.filter("type = 'heading'").orderBy("ord").collect()] == ["Start", "End"]
        assert b.agg({"dom_path": "max"}).first()[0] == "html > body > p:nth-child(9999)" and b.count() == 60_002


def test_references_without_a_semicolon_are_text():
    root = dom.parse('<h1>a&amp;&lt;b&eacute;&#38;&amp</h1><p title="x&amp;y" class="&lt">r&copyright &nosuch; &ltd&amp;<b>&amp&amp;</b></p><!-- &amp --><script>a&ampb</script>')
    h, p, script = root.elements
    assert h.text() == "a&<b\u00e9&&amp" and p.text() == "r&copyright &nosuch; &ltd&&amp&"
    assert p.get("title") == "x&y" and p.get("class") == "<" and script.text() == "a&ampb"
