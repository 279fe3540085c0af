import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pagewright.operators import dom, extract, navigation, results, selectors
from pagewright.operators.htmltree import parse_html

QUERY_PAGE = """<body class="shop"><header><img alt="logo" src="l.svg"></header><form id="order" data-step="2" data-cart="7">
<label>Rope <input name="rope" value="12"></label><label class="big due">Oars <em>a pair</em></label><button>Send</button></form>
<table id="stock"><tr><td>tar</td><td lang="nl-BE">teer</td></tr><tr><td>twine</td><td>garen</td></tr><tr><td colspan="2">none else</td></tr></table>
<footer><a href="/tariff" rel="help">Tariff</a> <a href="/wharf">Wharf</a></footer>"""


def written(node):
    if node.kind == "element":
        return f"<{node.tag}>" + "".join(map(written, node.kids)) + f"</{node.tag}>"
    return node.text if node.kind == "text" else "".join(map(written, node.kids))


@pytest.mark.parametrize("source, body", [
    ("<p><b>x<br><p>y<p>z</b>w", "<p><b>x<br></br></b></p><p><b>y</b></p><p><b>z</b>w</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<i>a<b>b</i>c</b>", "<i>a<b>b</b></i><b>c</b>"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></tbody></table>"),
    ("<a>x<a>y", "<a>x</a><a>y</a>"), ("<select><option>a<option>b</select>c", "<select><option>a</option><option>b</option></select>c"),
    ("<p>a<div>b</p>c", "<p>a</p><div>b<p></p>c</div>"), ("5 < 6 &amp; x", "5 < 6 & x"), ("<script>a</b></script>t", None)])
def test_tree(source, body):
    whole = written(parse_html(source))
    if body is None:
        assert whole == "<html><head><script>a</b></script></head><body>t</body></html>"
    else:
        assert whole == f"<html><head></head><body>{body}</body></html>"


def test_deep_and_wide_pages_stay_cheap(spark, pages_of):
    rows = dom.html_nodes(pages_of("<div>" * 700 + "x", "<div>" * 30000 + "x" + "<b><i>" * 500 + "<p>y" * 50))
    deepest = {r.page_id: r.d for r in rows.groupBy("page_id").agg(F.max("depth").alias("d")).collect()}
    assert deepest[0] == 703 and deepest[1] > 30000
    assert selectors.css_select(dom.html_nodes(pages_of("<div>" * 700 + "<p>x"), ("div", "p")), "div > p").count() == 1


def test_intervals(spark, pages_of):
    nodes = {r.node_id: r for r in dom.html_nodes(pages_of(QUERY_PAGE)).collect()}
    whole = nodes[0].text.encode()
    for node in nodes.values():
        inside = [n for n in nodes.values() if node.node_id <= n.node_id <= node.end_id]
        text = "".join(n.text for n in sorted(inside, key=lambda n: n.node_id) if n.kind == "text")
        assert whole[node.text_from:node.text_to].decode() == text
        if node.parent_id is not None:
            assert nodes[node.parent_id].end_id == node.parent_end


SELECTORS = {
    "form": 1, "td": 5, "a[href='/wharf']": 1, "label.big": 1, "label.due.big em": 1, "#stock td": 5, "tr > td:first-child": 3,
    "tr + tr": 2, "header ~ table": 1, "tr:nth-child(2n+1)": 2, "td:not(:last-child)": 2, "[data-cart]": 1, "a, img": 3, "*": 24,
    "body > form > label": 2, "form[id^=ord] [class]": 1, "ul": 0, "label + label": 1, "[class~=due]": 1, "[lang|=nl]": 1, "header + table": 0,
    "td:only-child": 1, "tbody > tr:last-child td": 1}


def test_selectors(spark, pages_of):
    nodes = dom.html_nodes(pages_of(QUERY_PAGE, "<p>none")).cache()
    for selector, expected in SELECTORS.items():
        assert selectors.css_select(nodes, selector).filter("page_id = 0").count() == expected, selector
        tags = selectors.needed_tags(selector)
        if tags is not None:
            pruned = dom.html_nodes(pages_of(QUERY_PAGE), tags, kinds=("element",))
            assert selectors.css_select(pruned, selector).count() == expected, selector


def test_selectors_on_pruned_rows(spark, pages_of):
    page = "<ul><li>a<p>x</p></li></ul><ol><li>b</li><p>between</p><li>c</li><li>d</li></ol>"
    for rows in (dom.html_nodes(pages_of(page)), dom.html_nodes(pages_of(page), ("li",))):
        assert selectors.css_select(rows, "li + li").count() == 1
    pruned = dom.html_nodes(pages_of(page), ("li",)).filter("depth > 0")
    with pytest.raises(ValueError, match="needs rows of ol"):
        selectors.css_select(pruned, "ol > li")


@pytest.mark.parametrize("selector", ["[[[invalid", "", "a >", "a,", "p:hover", "a::before", "> p", ":nth-child(x)"])
def test_bad_selectors(spark, pages_of, selector):
    nodes = dom.html_nodes(pages_of(QUERY_PAGE))
    with pytest.raises(ValueError):
        selectors.css_select(nodes, selector)
    assert selectors.select_or_nothing(nodes, selector).count() == 0


def test_values(spark, pages_of):
    nodes = dom.html_nodes(pages_of(QUERY_PAGE)).cache()
    assert [r.value for r in selectors.css_values(nodes, "label").orderBy("node_id").collect()] == ["Rope ", "Oars a pair"]
    assert selectors.css_values(nodes, "label.big", "innerHTML").first().value == "Oars <em>a pair</em>"
    assert [r.value for r in selectors.css_values(nodes, "footer a", "rel").orderBy("node_id").collect()] == ["help", None]
    assert [r.value for r in selectors.css_values(nodes, "header", "id").collect()] == [None]
    assert [r.n for r in selectors.css_count(nodes, "tr").collect()] == [3]
    assert selectors.title_of(dom.html_nodes(pages_of("<title> A b</title>"))).first().title == " A b"
    assert selectors.by_id(nodes, "order").first().attrs["data-step"] == "2"
    assert selectors.by_class(nodes, "due big").count() == 1 and selectors.by_name(nodes, "rope").count() == 1
    assert selectors.links_of(nodes).count() == 2 and selectors.forms_of(nodes).count() == 1
    hit = selectors.by_id(nodes, "order").select(selectors.data_attributes().alias("d"), selectors.has_attribute("hidden").alias("h")).first()
    assert hit.d == {"step": "2", "cart": "7"} and hit.h is False
    spot = {r.tag: r for r in nodes.filter("tag IN ('form', 'em', 'table')").collect()}
    inside = nodes.select(selectors.contains(F.lit(spot["form"].node_id), F.lit(spot["form"].end_id), F.col("node_id")).alias("c"), "tag")
    assert {r.tag for r in inside.filter("c").collect() if r.tag} == {"form", "label", "input", "em", "button"}


def test_walking(spark, pages_of):
    page = "<div id=o><section><p>1</p></section><div id=i><p>2</p><span><p>3</p></span></div><p>4</p></div><p>5</p>"
    nodes = dom.html_nodes(pages_of(page), texts=("p",)).cache()
    ids = {r.attrs.get("id"): r.node_id for r in nodes.filter("tag = 'div'").collect()}
    near = {r.text: r.closest_id for r in selectors.closest(nodes, "div").filter("tag = 'p'").collect()}
    assert near == {"1": ids["o"], "2": ids["i"], "3": ids["i"], "4": ids["o"], "5": None}
    first = {r.node_id: r.match_id for r in selectors.first_match(nodes, "p", "div").collect()}
    texts = {r.node_id: r.text for r in nodes.filter("tag = 'p'").collect()}
    assert {k: texts[v] for k, v in first.items()} == {ids["o"]: "1", ids["i"]: "2"}
    assert sorted(r.text for r in selectors.all_matches(nodes, "p", "#i").collect()) == ["2", "3"]
    assert sorted(r.text for r in selectors.children(nodes, "#i").filter("tag = 'p'").collect()) == ["2"]
    up = {r.node_id: r.parent_tag for r in selectors.parents(nodes).collect()}
    assert all(up[n] == ("span" if t == "3" else "section" if t == "1" else "body" if t == "5" else "div") for n, t in texts.items())


def test_edits(spark, pages_of):
    nodes = dom.html_nodes(pages_of("<nav>n</nav><p class=x>a <b>b</b></p><p></p>")).cache()
    changed = selectors.set_attribute(selectors.remove_attribute(nodes, "p", "class"), "p", "title", "T")
    assert [r.attrs for r in changed.filter("tag = 'p'").collect()] == [{"title": "T"}] * 2
    assert selectors.live_text(selectors.drop_elements(nodes, "nav")).first().content == "a b"
    put = selectors.set_text(nodes, "p", "new")
    assert selectors.live_text(put).first().content == "nnewnew"
    assert selectors.css_select(put, "b").count() == 0
    both = {r.node_id for r in put.collect()}
    assert len(both) == put.count()


def test_markup(spark, pages_of):
    page = '<div id=d title="a&quot;b"><br>x &lt; y<script>1 < 2</script><!--c--><b>z</b></div>'
    nodes = dom.html_nodes(pages_of(page))
    row = selectors.markup(nodes, "#d").first()
    assert row.inner_html == "<br>x &lt; y<script>1 < 2</script><!--c--><b>z</b>"
    assert row.outer_html == '<div id="d" title="a&quot;b">' + row.inner_html + "</div>"


def test_click_targets(spark, pages_of):
    page = '<form id=f><input><input type=checkbox><button><b>x</b></button></form><a href="/q">l</a><a>n</a><button>alone</button>'
    found = selectors.click_target(dom.html_nodes(pages_of(page)), "form, input, button, a").orderBy("node_id").collect()
    assert [(r.action, r.target) for r in found] == [
        ("submit", "form#f"), ("submit", "form#f"), (None, None), ("submit", "form#f"), ("link", "/q"), (None, None), (None, None)]


def test_links(spark, pages_of):
    page = """<a href="/x">X</a><a href="/i"><img alt="Icon"></a><a href="/e"><img></a><a href="/t" title="Ti"></a>
    <a href="/l" aria-label="La"></a><a href="/b" title=" " aria-label="no"></a><a href="https://example.com/x">again</a><a>none</a>
    <a href="https://o.com/">O <b>ut</b></a>"""
    found = extract.page_links(pages_of(page)).orderBy("pos").collect()
    assert [(r.i, r.pos, r.text, r.href) for r in found] == [
        (0, 0, "X", "/x"), (1, 1, "Icon", "/i"), (2, 2, "img", "/e"), (3, 3, "Ti", "/t"), (4, 4, "La", "/l"), (7, 5, "O ut", "https://o.com/")]


@pytest.mark.parametrize("head, expected", [
    ('<meta charset="utf-8">', "text/html; charset=utf-8"),
    ('<meta charset="utf-8"><meta http-equiv="Content-Type" content="text/x">', "text/x"),
    ('<meta http-equiv="content-type" content="text/y"><meta charset="u">', "text/y"),
    ('<meta charset="a"><meta http-equiv="content-type"><meta charset="b">', "text/html; charset=b"), ("", None)])
def test_content_type(spark, pages_of, head, expected):
    assert extract.page_metadata(pages_of(f"<html lang=de><head>{head}<body>x")).first().content_type == expected


def test_description_and_title(spark, pages_of):
    row = extract.page_summary(pages_of('<title> Test </title><meta name=Description content="one"><meta name=description><body>abcdefgh<script>1234</script>')).first()
    assert (row.title, row.description, row.page_tokens) == ("Test", None, 3)
    assert extract.page_titles(pages_of("<title> </title>", "x")).filter("title IS NOT NULL").count() == 0


WORDS = "word " * 500


def test_content_selectors(spark, pages_of):
    page = f"""<body><main><p>{WORDS}</main><div id=z>{WORDS}{WORDS}</div><div id=small>x</div><h2 id=a>A</h2><p>{WORDS}<h3 id=b> B </h3><p>{WORDS}
<div class="mw-heading mw-h2"><h2 id=c>C</h2></div><p>{WORDS}</p><h2 id=e></h2><div><h1>x</h1></div>{WORDS}"""
    rows = extract.content_selectors(extract.content_nodes(pages_of(page, "<article>short"))).orderBy("rank").collect()
    assert [(r.selector, r.tokens_est, r.label) for r in rows] == [
        ("#z", 1250, None), ("main", 625, None), ("#a", 1251, "A"), ("#b", 625, "B"), ("#c", 625, "C")]
    same = extract.content_selectors(extract.content_nodes(pages_of(f"<article id=q class=post-content>{WORDS}</article>"))).collect()
    assert [r.selector for r in same] == ["article"]


def test_section_bounds_against_brute_force(spark, pages_of):
    page = "<h1>t</h1>p0<h2>a</h2>p1<h3>b</h3><p>p2</p><div><h2>c</h2>in</div><div class='mw-heading'><h3>d</h3></div>p3<div>x<h4>e</h4></div><h1>f</h1>"
    found = {r.text: r.section_bytes for r in extract.section_extent(dom.html_nodes(pages_of(page), texts=("h1", "h2", "h3", "h4"))).collect()}
    assert found == {"t": len("p0ap1bp2cindp3xe"), "a": len("p1bp2"), "b": 2, "c": 2, "d": len("p3xe"), "e": 0, "f": 0}
    nodes = dom.html_nodes(pages_of(page))
    assert extract.section_text(nodes, "h3").first().content == "bp2\n\ndp3xe"


def test_tables(spark, pages_of):
    page = "<table><thead><tr><td>h1<td>h2</thead><tr><td>a <b>b</b>\n c<tr><td>1<td>2<td>3<table><tr><td>in</table></table><table><tr><th>x</table>"
    rows = extract.page_tables(pages_of(page)).orderBy("table_id", "row_no").collect()
    assert [(r.is_header, r.cells) for r in rows] == [(True, ["h1", "h2"]), (False, ["a b c"]), (False, ["1", "2", "3in"]), (True, ["x"])]
    texts = extract.table_text(extract.page_tables(pages_of(page))).orderBy("table_id").collect()
    assert texts[0].content == "| h1 | h2 |  |\n|---|---|---|\n| a b c |  |  |\n| 1 | 2 | 3in |" and texts[1].content == "| x |\n|---|"


def test_redirects(spark):
    bodies = [f'<meta http-equiv=Refresh content="0;url=/p{n + 1}">' for n in range(8)] + ["<p>end", '<script>window.location.href = "/p8"</script>', '<meta http-equiv=refresh content="0;url=/p10">']
    pages = spark.createDataFrame([(n, f"https://e.com/p{n}", b) for n, b in enumerate(bodies)], "page_id long, url string, html string")
    moves = navigation.redirect_moves(extract.client_redirect(extract.redirect_nodes(pages)), pages)
    ends = {r.page_id: (r.final_url[-2:], r.hops) for r in navigation.follow_redirects(pages.select("page_id", "url"), moves).collect()}
    assert ends == {0: ("p5", 5), 1: ("p6", 5), 2: ("p7", 5), 3: ("p8", 5), 4: ("p8", 4), 5: ("p8", 3), 6: ("p8", 2), 7: ("p8", 1), 8: ("p8", 0), 9: ("p8", 1), 10: ("10", 0)}


def test_pages_behind_redirects(spark):
    bodies = ['<meta http-equiv=refresh content="0;url=/p1">', '<meta http-equiv=refresh content="0;url=/p2">', "<p>end", '<meta http-equiv=refresh content="0;url=/gone">',
              '<meta http-equiv=refresh content="0;url=/p5">', '<meta http-equiv=refresh content="0;url=/p2">']
    pages = spark.createDataFrame([(n, f"https://e.com/p{n}", b, 200 + n, "image/png" if n == 5 else None) for n, b in enumerate(bodies)],
                                  "page_id long, url string, html string, status int, content_type string")
    found = {r.page_id: (r.url[14:], r.html, r.status, r.hops) for r in navigation.replaced_pages(pages).collect()}
    end = ("p2", "<p>end", 202)
    assert {n: found[n] for n in (0, 1, 2)} == {0: (*end, 2), 1: (*end, 1), 2: (*end, 0)}
    assert found[3] == ("p3", bodies[3], 203, 0)  # the target answers nothing, so the page itself stays
    assert found[4][0] == "p5" and found[4][2:] == (205, 1) and found[5][2:] == (205, 0)  # a binary answer moves nobody on


def test_results_and_report(spark, pages_of):
    page = f"<title>T</title><main>{WORDS}</main><a href=/l>L</a>"
    row = results.page_results(pages_of(page)).first()
    assert row.markdown.startswith("Page has content sections") and row.content_selectors[0].selector == "main"
    plain = results.page_results(pages_of(page), show_selectors_first=False, max_tokens=5)
    row = plain.first()
    assert results.page_results(pages_of("<h2>x</h2><p>a <a href=/l>L</a>")).first().markdown == "## x\na [L](/l)"
    assert row.truncated and row.content_selectors is None and [tuple(k) for k in row.links] == [(0, "L", "/l")]
    report = results.page_report(plain).first().report
    assert "**Title:** T\n" in report and "**Truncated:** true (use offset=" in report
    compact = results.page_results(pages_of("<p><a href=/a>A</a> <a href=/b>B</a>"), compact_links=True).first()
    assert compact.markdown == "[A][0][B][1]" and [k.href for k in compact.links] == ["/a", "/b"]


def test_response_kinds(spark):
    rss = "<rss><channel><title>T</title><item><title>x</title><link>/l</link></item></channel></rss>"
    responses = spark.createDataFrame([
        (1, "https://e.com/a", 200, "image/png", None, b"1234"), (2, "https://e.com/f", 200, "text/xml", rss, None), (3, "https://e.com/h", 404, None, "<title>h</title><p>x", None)],
        "page_id long, url string, status int, content_type string, html string, body binary")
    found = {r.page_id: r for r in results.response_results(responses).collect()}
    assert (found[1].markdown, found[1].tokens_est) == ("[Binary content: image/png, 4 bytes]", 10)
    assert found[2].markdown == "# T\n\n## [x](/l)" and found[3].status == 404


def test_map_dom_and_types(spark, pages_of):
    def count(page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": [page.page_id[0]], "n": [int((page.tag == "p").sum())]})

    assert extract.map_dom(dom.html_nodes(pages_of("<p>a<p>b")), count, "page_id long, n long").first().n == 2
    values = ["1", '"a"', "[1]", '{"a":1}', "null", "true", None, "1.5"]
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string").orderBy("n")
    assert [r[0] for r in frame.select(extract.result_type(F.col("v"))).collect()] == [
        "number", "string", "array", "object", "null", "boolean", "undefined", "number"]


def test_follow(spark, pages_of):
    links = extract.page_links(pages_of("<a href=/one>First Link</a><a href=/two>Second link</a>"))
    asked = spark.createDataFrame([(1, 0, 1), (2, 0, 5)], "event_id long, page_id long, `index` int")
    found = {r.event_id: (r.target, r.code) for r in navigation.follow_by_index(asked, links).collect()}
    assert found == {1: ("https://example.com/two", None), 2: (None, "LINK_NOT_FOUND")}
    asked = spark.createDataFrame([(1, 0, "LINK"), (2, 0, "none")], "event_id long, page_id long, needle string")
    found = {r.event_id: (r.target, r.code) for r in navigation.follow_by_text(asked, links).collect()}
    assert found == {1: ("https://example.com/one", None), 2: (None, "LINK_NOT_FOUND")}


@pytest.mark.parametrize("n", [0, 1, 2, 10, 250_000])
def test_savings_are_exact_without_all_values_in_one_task(spark, n, monkeypatch):
    rows = spark.range(n).select((F.xxhash64("id") % 100_003 + 200_000).alias("tokens_est"), F.array(F.struct((F.col("id") % 97 + 1).alias("tokens_est"))).alias("content_selectors"))
    x = rows.select((F.col("tokens_est") / F.col("content_selectors")[0]["tokens_est"]).alias("x"))
    wanted = x.agg(F.count("*"), F.round(F.percentile("x", 0.5), 6), F.round(F.percentile("x", 0.9), 6)).first()
    seen = []
    ordered = results._bracketed
    monkeypatch.setattr(results, "_bracketed", lambda values, *rest: seen.append(ordered(values, *rest)) or seen[-1])
    found = results.section_savings(rows)
    assert tuple(found.first()) == tuple(wanted)
    # No aggregate that holds all values is left.
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    if n > 10 * results.ACCURACY:
        assert all("x#" in f._jdf.queryExecution().optimizedPlan().toString() and ">=" in f._jdf.queryExecution().optimizedPlan().toString() for f in seen)


def test_pages_made_of_narrow_rows_are_dealt_out(spark, tmp_path):
    from pagewright.plans import inputs

    spark.range(20_000).selectExpr("id AS c_custkey", "'n' AS c_name", "'s' AS c_mktsegment", "1 AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for made in (inputs.customer_forms, inputs.nation_tables):
        held = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in held) == 20_000 and max(r["count"] for r in held) < 1.2 * inputs.PAGES_PER_TASK


def test_depth_profile_ships_what_it_asks_for(spark):
    plan = queries()["depth_profile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "depth" in made and "attrs" not in made and "text" not in made
