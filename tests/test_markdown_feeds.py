import random
import re

import pytest

from __spark_entry__ import queries
from pagewright.operators import dom, feeds
from pagewright.operators.htmltree import parse_html
from pagewright.operators.markdown import CELLS, CONTEXT, NODE_COLUMNS, NODE_TAGS, _chosen, assemble, chunks, html_markdown, whole_pages
from pagewright.operators.selectors import css_flag, css_select
from pagewright.plans import inputs
from plain_markdown import render_tree

URL = "https://example.com/a/"
OPTIONS = {"strip_nav": False, "include_links": True, "include_images": False, "compact_links": False}
RULES = [
    ("<h1>T</h1><h3>S</h3>", "# T\n### S\n"), ("<p>a</p><p>b</p>", "a\n\nb\n\n"), ("a<br>b<hr>c", "a\nb\n---\nc"),
    ("<b>x</b> y", "**x**y"), ("<b> </b><i></i><em>e</em>", "*e*"), ("<code>c</code>", "`c`"),
    ("<pre><code>a\n  b</code></pre>", "```\na\n  b\n```\n"), ("<blockquote><p>q</p></blockquote>", "> q\n> \n"),
    ("<blockquote>a<blockquote>b</blockquote>c</blockquote>", "> a\n> > b\n> \n> c\n\n"), ("<blockquote> </blockquote>x", "x"),
    ("<ul><li>a<ol><li>x<li>y</ol><li> <li>b</ul>", "- a\n  1. x\n  2. y\n- b\n"), ("<li>alone", "- alone"),
    ("<ul><li>a<blockquote><ol><li>x</ol></blockquote></ul>", "- a\n> 1. x\n"),
    ("<img src=/i.png alt=A><img alt=no>", "![A](/i.png)"), ("<script>x</script><style>y</style><noscript>z</noscript>t", "t"),
    ("<a href=/x><h2>Head</h2></a>", "[Head](/x)"), ("<a href=/x>1</a><a href=/x>2</a>", "[1](/x)"),
    ("<a href=/x><b></b></a><a href=/y><img></a><a href=/z title=' t '></a>", "[img](/y)[t](/z)"),
    ("<a href=/x>a<p>b</p> c</a>", "[a b c](/x)"), ("<ul><li><a href=/x>a</a><li><a href=/x>b</a></ul>", "- [a](/x)\n"),
    ("<a href=/x>in</a><blockquote><a href=/x>q</a></blockquote>", "[in](/x)\n> [q](/x)\n\n"),
    ("<table><tr><th>A<th>B<tr><td>1</table>", "| A | B |\n|---|---|\n| 1 |  |\n\n"),
    ("<table><thead><tr><td>h<tbody><tr><td>1<table><tr><td>in</table></table>", "| h |\n|---|\n| 1in |\n\n"), ("<table></table>x", "\nx"), ("", "")]
TAGS = "p div section h1 h2 h3 b em strong i ul ol li blockquote a a a code pre br hr img table span nav header script article".split()
WORDS = ["x", "foo bar ", " ", " b", "*", "_", "\n", "a\n\nb", " tail ", "&amp;amp; q"]


def random_page(rng, depth=4):
    out = []
    for _ in range(rng.randint(0, 5)):
        tag = rng.choice(TAGS)
        if rng.random() < 0.4 or not depth:
            out.append(rng.choice(WORDS))
        elif tag in ("br", "hr"):
            out.append(f"<{tag}>")
        elif tag == "img":
            out.append(rng.choice(["<img src=/i alt=A>", "<img>", "<img alt=' '>", "<img src=x>"]))
        elif tag == "a":
            out.append(rng.choice(["<a href=/1>", "<a href=/2>", "<a href=/3 title=T>", "<a>", "<a href=/4 aria-label=' L  l '>"]) + random_page(rng, depth - 1) + "</a>")
        elif tag == "table":
            rows = ("".join(f"<{rng.choice(['td', 'td', 'th'])}>" + rng.choice(["c", "c  d", "", "<b>z</b>"]) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 3)))
            out.append("<table>" + "".join("<tr>" + row for row in rows) + "</table>")
        else:
            out.append(f"<{tag}>" + random_page(rng, depth - 1) + f"</{tag}>")
    return "".join(out)


def raw(pages, **options):
    nodes = dom.html_nodes(pages, NODE_TAGS, kinds=("element", "text"), texts=CELLS, page_text=False, columns=NODE_COLUMNS)
    rows = assemble(whole_pages(dom.clustered(nodes)), **{**OPTIONS, **options}).collect()
    return {r.page_id: (r.raw, [(k.i, k.text, k.href) for k in r.refs]) for r in rows}


def test_rules(pages_of):
    found = raw(pages_of(*[source for source, _ in RULES], url=URL), include_images=True)
    assert [found[n][0] for n in range(len(RULES))] == [text for _, text in RULES]


@pytest.mark.parametrize("options", [{"include_images": True, "compact_links": True}, {"strip_nav": True, "include_links": False}])
def test_random_pages(pages_of, options):
    rng = random.Random(len(options))
    sources = [random_page(rng) for _ in range(400)]
    found = raw(pages_of(*sources, url=URL), **options)
    for n, source in enumerate(sources):
        text, refs = render_tree(URL, parse_html(source), None, {**OPTIONS, **options})
        assert found[n] == (text, [(i, r["text"], r["href"]) for i, r in enumerate(refs)]), source


def test_options(pages_of):
    page = "<nav>N</nav><header>H</header><p><a href=/l>L</a></p><footer>F</footer>"
    assert raw(pages_of(page), strip_nav=True)[0][0] == "[L](/l)\n\n"
    assert raw(pages_of("<a href=/l>L</a>"), include_links=False)[0][0] == "L"
    assert raw(pages_of("<img src=i>"))[0][0] == ""
    assert raw(pages_of("<a href=/a>A</a><a href=/b>B</a>"), compact_links=True)[0] == ("[A][0][B][1]", [(0, "A", "/a"), (1, "B", "/b")])


def test_chosen_parts(pages_of):
    page = ("<div>a<div>b</div></div><ul><li>one<li>two<ol><li>in</ol></ul><h2>H</h2><p>x</p><h3>S</h3><p>y</p><h2>I</h2><p>z</p>"
            "<table><tr><td>T</table>")
    expected = {
        "div": "a\nb\n\nb", "li": "- one\n\n- two\n1. in\n\n- in", "h2": "## H\nx\n\n### S\ny\n\n## I\nz\n\n| T |\n|---|", "[[[": ""}
    for selector, text in expected.items():
        assert [r.markdown for r in html_markdown(pages_of(page), selector=selector).collect()] == [text]


@pytest.mark.parametrize("selector", ["h1, h2, section, li, blockquote, a"])
def test_chosen_parts_of_random_pages(pages_of, selector):
    rng = random.Random(len(selector))
    sources = [random_page(rng) for _ in range(150)]
    nodes = dom.html_nodes(pages_of(*sources, url=URL), texts=CELLS, page_text=False, columns=[*dom.COLUMNS, *CONTEXT]).cache()
    hits = {}
    for row in css_select(nodes, selector).collect():
        hits.setdefault(row.page_id, set()).add(row.node_id)
    found = {r.page_id: r.raw for r in assemble(_chosen(dom.clustered(nodes), selector)).collect()}
    for n, source in enumerate(sources):
        assert found[n] == render_tree(URL, parse_html(source), hits.get(n, set()), OPTIONS)[0], source


def test_pages_to_markdown(spark, pages_of):
    page = "<nav>N</nav><article><h2>Head</h2><p>One &amp;amp; two</p><h3>Sub</h3><p>More</p><h2>Next</h2><p>Rest</p></article>"
    assert html_markdown(pages_of(page)).first().markdown == "N\n\n## Head\nOne & two\n\n### Sub\nMore\n\n## Next\nRest"
    assert html_markdown(pages_of(page), selector="h2").first().markdown == "## Head\nOne & two\n\n### Sub\nMore\n\n## Next\nRest"
    assert html_markdown(pages_of(page), selector="h3, nav").first().markdown == "N\n\n### Sub\nMore"
    assert [r.markdown for r in html_markdown(pages_of(page), selector="[[[").collect()] == [""]


def test_deep_pages_to_markdown(pages_of):
    row = html_markdown(pages_of("<div>" * 5000 + "<ul><li>x")).first()
    assert row.markdown == "- x"


def test_truncation_pages(spark, pages_of):
    page = "<p>" + "<br>".join(f"Line {n} has some text" for n in range(40)) + "</p>"
    row = html_markdown(pages_of(page), max_tokens=50).first()
    assert row.truncated and row.tokens_est <= 50 and row.next_offset == row.tokens_est
    row = html_markdown(pages_of(page), offset=99999, max_tokens=5).first()
    assert row.markdown == "" and not row.truncated
    md = html_markdown(pages_of(page)).select("page_id", "markdown")
    parts = chunks(md, "markdown", 30).orderBy("chunk_no").collect()
    assert "".join(r.chunk for r in parts) == md.first().markdown and len(parts) > 5


RSS = """<?xml version="1.0" encoding="iso-8859-1"?><rss version="2.0"><channel><title>Té</title><link>https://example.com</link>
<description>About  it</description><item><title>Boats for hire</title><link>https://example.com/1</link><description><![CDATA[<b>Ahoy</b> &amp; x]]></description>
<pubDate>Mon</pubDate><category>Harbour</category></item><item><title>Nets</title><description>a & b</description></item><item><description>none</description></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>R</title></channel><item><title>I</title><link>https://o.com/i</link>
<dc:date>2031-12-01T06:30:00Z</dc:date><dc:subject>Weather</dc:subject></item></rdf:RDF>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><subtitle>A</subtitle><updated>U</updated><link rel="self" href="/self"/><link href="/home"/>
<entry><title>E</title><link rel="edit" href="/e"/><link rel="self" href="/s"/><link href="/alt"/><category term="c"/><summary>s</summary></entry><entry><link href="/only"/></entry></feed>"""
CUT = "<rss><channel><title>C</title><item><title>one</title></item><item><title>tw"


def test_feeds(spark, pages_of):
    rows = feeds.feed_rows(pages_of(RSS, RDF, ATOM, CUT, "not xml", url="https://example.com/feed")).cache()
    items = feeds.feed_items(rows).orderBy("page_id", "idx").collect()
    assert [(r.page_id, r.title, r.link, r.date, r.category) for r in items] == [
        (0, "Boats for hire", "https://example.com/1", "Mon", "Harbour"), (0, "Nets", None, None, None),
        (1, "I", "https://o.com/i", "2031-12-01T06:30:00Z", "Weather"), (2, "E", "/alt", None, "c"), (2, None, "/only", None, None), (3, "one", None, None, None)]
    heads = {r.page_id: (r.title, r.link, r.updated) for r in feeds.feeds(rows).collect()}
    assert heads[0] == ("Té", "https://example.com", None) and heads[2] == ("A", "/home", "U") and heads[4] == (None, None, None)
    text = {r.page_id: r.markdown for r in feeds.feed_markdown(rows).collect()}
    assert text[0] == "# Té\n*About it*\n\n## [Boats for hire](/1)\nMon · Harbour\n\nAhoy & x\n\n## Nets\n\na & b"
    assert text[1] == "# R\n\n## [I](https://o.com/i)\n2031-12-01T06:30:00Z · Weather"
    assert text[2] == "# A\n*Updated: U*\n\n## [E](/alt)\nc\n\ns\n\n## [(untitled)](/only)" and text[4] == ""
    assert feeds.feed_markdown(rows, include_links=False).filter("page_id = 3").first().markdown == "# C\n\n## one"
    assert [(r.page_id, r.i, r.href) for r in feeds.feed_links(rows).orderBy("page_id", "i").collect()] == [
        (0, 0, "/1"), (1, 0, "https://o.com/i"), (2, 0, "/alt"), (2, 1, "/only")]


def test_chosen_parts_run_in_methods_that_are_compiled(spark, capsys):
    """The engine never compiles a method of more than 8,000 bytes, it interprets it row by row."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries()["markdown_headings"](spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_shares_of_pages_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(dom, "PAGES_PER_SHARE", 10)
    for made, selector in ((inputs.pages, "nav"), (inputs.document_articles, "h2")):
        pages = made(spark, "/root/testdata/sf0.001")
        shares = -(-pages.count() // 10)
        rows = dom.clustered(dom.html_nodes(pages, kinds=("element",)))
        assert rows.rdd.getNumPartitions() == shares > 4
        assert css_flag(rows, "body > p").rdd.getNumPartitions() == shares
        assert html_markdown(pages, selector=selector).count() == pages.count()
