"""Registered queries: every operator over whole tables, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import mime, sqlnames, text, urls
from pagewright.operators import (
    commands, cookies, dom, extract, feeds, forms, history, markdown, navigation, results, rules, secrets, selectors, storage)
from pagewright.plans import inputs
from pagewright.session import checkpointed
from pagewright.sources import pages as page_io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKEN_PATTERN = [("token", 'token = "[0-9a-f]{40}"')]
HEADER_RULES = [
    (1, ["*.example.com"], {"X-Zone": "com", "X-Any": "1"}), (2, ["*.example.net", "*.example.org"], {"X-Zone": "other"}),
    (3, ["*.EXAMPLE.org"], {"X-Zone": "org", "X-Org": "yes"}),
]
AUTH_PROFILES = [
    ("com", "Authorization", "c0m", "Bearer ", ["*.example.com"]), ("net", "X-Key", "n3t", None, ["*.example.net", "example.net"])]
CONTENT_TYPES = ["text/html; charset=UTF-8", "image/png", "application/rss+xml", "application/ld+json;x=1", "text/xml", "application/pdf",
                 None, 'text/plain; charset="latin1"']


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _host_column(url="url") -> Column:
    return urls.host(url)


# -- pages: titles, metadata, links, selection


@query
def page_titles(spark, sf):
    return extract.page_titles(inputs.pages(spark, sf))


@query
def page_meta(spark, sf):
    return extract.page_metadata(inputs.pages(spark, sf))


@query
def page_tokens(spark, sf):
    return extract.page_tokens(inputs.pages(spark, sf))


@query
def links(spark, sf):
    return extract.page_links(inputs.pages(spark, sf)).select("page_id", "i", "pos", "text", "href")


@query
def links_per_host(spark, sf):
    """Flagship: parse, extract and shorten links, then count them per site."""
    found = extract.page_links(inputs.pages(spark, sf))
    return found.groupBy(_host_column().alias("host")).agg(
        F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"), F.countDistinct("href").alias("hrefs"))


@query
def css_paragraph_text(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("article", "p"), texts=("p",))
    hits = selectors.css_select(nodes, "article p")
    order = F.row_number().over(selectors.by_page())
    return hits.select("page_id", order.alias("nth"), F.col("text").alias("content"))


@query
def css_counts(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), kinds=("element",))
    rows = nodes
    names = {"nav_links": "nav li > a[href^='/']", "paras": "article > p", "later_items": "li + li",
             "first_items": "ul li:first-child", "metas": "meta[charset='utf-8'], title", "not_ads": "body > div:not(.ad)"}
    for name, selector in names.items():
        rows = selectors.css_flag(rows, selector, name)
    return rows.groupBy("page_id").agg(*[F.sum(F.col(n).cast("bigint")).alias(n) for n in names])


@query
def children_count(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("nav", "ul", "li", "a"))
    stats = selectors.child_stats(nodes).filter("parent_tag = 'ul'")
    return stats.groupBy("page_id").agg(F.sum("child_count").alias("items"), F.sum("child_nodes").alias("nodes"))


@query
def sibling_steps(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("li",))
    steps = selectors.sibling_links(nodes).filter("tag = 'li'")
    return steps.groupBy("page_id").agg(
        F.count("next_elem").alias("with_next"), F.count("prev_elem").alias("with_prev"), F.count("*").alias("items"))


@query
def parent_tags(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("ul", "li", "a"))
    return selectors.parents(nodes).filter("tag = 'a'").groupBy("page_id", "parent_tag").agg(F.count("*").alias("n"))


@query
def closest_nav(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("nav", "article", "a", "p"))
    near = selectors.closest(nodes, "nav, article").filter(F.col("tag").isin("a", "p"))
    return near.groupBy("page_id", "tag").agg(
        F.count("*").alias("n"), F.count("closest_id").alias("found"), F.countDistinct("closest_id").alias("areas"))


@query
def matches_flag(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("nav", "a"), kinds=("element",))
    return selectors.matches(nodes, "nav a").filter("tag = 'a'").groupBy("matched").agg(F.count("*").alias("n"))


@query
def first_link_in_nav(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("nav", "a"), kinds=("element",), texts=("a",))
    first = selectors.first_match(nodes, "a", scope="nav", value="text")
    return first.filter("match_id IS NOT NULL").select("page_id", F.col("value").alias("first_text"))


@query
def class_lookup(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("div",), texts=("div",))
    hits = selectors.by_class(nodes, "ad")
    return hits.select("page_id", F.array_join(selectors.class_list(), ",").alias("classes"),
                       selectors.has_attribute("id").alias("has_id"), F.col("text").alias("content"))


@query
def nav_markup(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf))
    return selectors.css_values(nodes, "nav", "innerHTML").select("page_id", F.col("value").alias("inner_html"))


@query
def text_without_nav(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf))
    kept = selectors.drop_elements(nodes, "nav, head, footer")
    return selectors.live_text(kept).select("page_id", F.md5(F.col("content")).alias("digest"), F.octet_length("content").alias("bytes"))


@query
def edited_titles(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf), ("title", "html"), kinds=("element", "text"))
    marked = selectors.set_attribute(selectors.set_text(nodes, "title", "Untitled"), "html", "data-seen", "1")
    return marked.groupBy("page_id").agg(
        F.max(F.when(F.col("kind") == "text", F.col("text"))).alias("title"),
        F.max(selectors.data_attributes()["seen"]).alias("seen"), F.max(F.col("attrs")["lang"]).alias("lang"))


@query
def article_text(spark, sf):
    nodes = dom.html_nodes(inputs.pages(spark, sf))
    hits = dom.with_text(selectors.css_flag(nodes, "article", "hit", keep_others=True), F.col("hit"))
    return hits.select("page_id", F.md5("content").alias("digest"), F.octet_length("content").alias("bytes"))


@query
def content_selectors(spark, sf):
    found = extract.content_selectors(extract.content_nodes(inputs.pages(spark, sf)))
    return found.select("page_id", "rank", "selector", "tokens_est", "label")


@query
def document_outline(spark, sf):
    nodes = dom.html_nodes(inputs.document_articles(spark, sf), ("h2",), texts=("h2",), kinds=("element",))
    return extract.outline(nodes, min_tokens=40).select("page_id", "selector", "tokens_est", "label")


@query
def section_content(spark, sf):
    nodes = dom.html_nodes(inputs.document_articles(spark, sf))
    return extract.section_text(nodes, "h2").select("page_id", F.md5("content").alias("digest"), F.octet_length("content").alias("bytes"))


@query
def selectors_first(spark, sf):
    rows = results.selectors_first(results.page_results(inputs.pages(spark, sf)))
    return rows.select("page_id", "notice", F.md5("markdown").alias("digest"), "tokens_est", F.size("content_selectors").alias("areas"))


@query
def page_results(spark, sf):
    rows = results.page_results(inputs.pages(spark, sf), min_tokens=0)
    return rows.select("page_id", "url", "title", "lang", "content_type", "tokens_est", "content_bytes", "truncated",
                       F.size("links").alias("links"), F.size("content_selectors").alias("areas"))


@query
def page_report(spark, sf):
    return results.page_report(results.page_results(inputs.pages(spark, sf), min_tokens=0))


@query
def stats_by_host(spark, sf):
    rows = results.page_results(inputs.pages(spark, sf), min_tokens=0)
    return results.corpus_stats(rows, _host_column(), "host")


@query
def stats_by_lang(spark, sf):
    rows = results.page_results(inputs.pages(spark, sf), min_tokens=0)
    return results.corpus_stats(rows, F.col("lang"), "lang")


@query
def section_savings(spark, sf):
    return results.section_savings(results.page_results(inputs.pages(spark, sf), min_tokens=0))


@query
def routed_responses(spark, sf):
    types = F.array(*[F.lit(t) for t in CONTENT_TYPES])[(F.col("page_id") % len(CONTENT_TYPES)).cast("int")]
    responses = inputs.pages(spark, sf).select(
        "page_id", "url", F.lit(200).alias("status"), types.alias("content_type"), "html", F.col("html").cast("binary").alias("body"))
    rows = results.response_results(responses, min_tokens=0)
    return rows.select("page_id", "title", "content_type", "tokens_est", F.col("markdown").startswith("[Binary").alias("is_binary"))


@query
def page_markdown(spark, sf):
    return markdown.html_markdown(inputs.pages(spark, sf)).select(
        "page_id", "tokens_est", "truncated", F.md5("markdown").alias("digest"))


@query
def markdown_nav(spark, sf):
    rows = markdown.html_markdown(inputs.pages(spark, sf), selector="nav")
    return rows.select("page_id", F.col("markdown").alias("nav"))


@query
def markdown_headings(spark, sf):
    """Every section of every document, rendered as a part of its own."""
    rows = markdown.html_markdown(inputs.document_articles(spark, sf), selector="h2")
    return rows.select("page_id", F.regexp_count("markdown", F.lit(r"(?m)^## Part \d+$")).cast("bigint").alias("sections"), "tokens_est", F.md5("markdown").alias("digest"))


@query
def depth_profile(spark, sf):
    def profile(page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": [page["page_id"].iloc[0]], "nodes": [len(page)], "max_depth": [page["depth"].max()]})

    return extract.map_dom(dom.html_nodes(inputs.pages(spark, sf), columns=("page_id", "node_id", "depth")), profile, "page_id bigint, nodes bigint, max_depth bigint")


@query
def result_types(spark, sf):
    return inputs.events(spark, sf).groupBy(extract.result_type(F.col("props")).alias("type")).agg(F.count("*").alias("n"))


# -- addresses and navigation


@query
def url_origin(spark, sf):
    return inputs.pages(spark, sf).select("page_id", urls.origin("url").alias("origin"), _host_column().alias("host"))


@query
def url_resolve(spark, sf):
    href = F.concat(F.lit("../x/./y?z="), F.col("page_id").cast("string"))
    return inputs.pages(spark, sf).select(
        "page_id", urls.resolve_url("url", href).alias("absolute"), urls.display_href("url", href).alias("shown"),
        urls.absolute_href("url", F.lit("#part")).alias("part"))


@query
def search_url(spark, sf):
    return inputs.table(spark, sf, "benchmark").select(
        "item_id", urls.search_url(F.lit("https://s.example/?q={}&x={}"), "text").alias("url"))


@query
def fetch_from_corpus(spark, sf):
    rows = inputs.events(spark, sf).withColumn("page_id", F.floor(F.col("event_id") / 25))
    asked = rows.join(inputs.pages(spark, sf).select("page_id", "url"), "page_id", "left").select(
        F.col("event_id").alias("request_id"), F.when(F.col("page_id") == 7, "not an address").otherwise(
            F.coalesce("url", F.lit(f"{inputs.SITE}/missing"))).alias("url"))
    return navigation.fetch_from_corpus(asked, inputs.pages(spark, sf)).select("request_id", "page_id", "code", "retryable")


@query
def link_graph(spark, sf):
    linked = inputs.linked_pages(spark, sf)
    return navigation.link_graph(extract.page_links(linked), inputs.pages(spark, sf)).select("src", "dst", "pos")


@query
def link_degrees(spark, sf):
    linked = inputs.linked_pages(spark, sf)
    return navigation.link_degrees(navigation.link_graph(extract.page_links(linked), inputs.pages(spark, sf)))


@query
def dangling_links(spark, sf):
    linked = inputs.linked_pages(spark, sf)
    return navigation.dangling_links(extract.page_links(linked), inputs.pages(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n"))


@query
def follow_by_index(spark, sf):
    asked = inputs.events(spark, sf).select("event_id", F.floor(F.col("event_id") / 40).alias("page_id"), (F.col("k") % 9).alias("index"))
    return navigation.follow_by_index(asked, extract.page_links(navigation.asked_pages(inputs.pages(spark, sf), asked))).select(
        "event_id", "target", "code")


@query
def follow_by_text(spark, sf):
    asked = inputs.events(spark, sf).select(
        "event_id", F.floor(F.col("event_id") / 40).alias("page_id"),
        inputs._pick(["TH", "e", "la", "zz"], F.col("k") % 4).alias("needle"))
    return navigation.follow_by_text(asked, extract.page_links(navigation.asked_pages(inputs.pages(spark, sf), asked))).select("event_id", "target", "code")


@query
def redirect_chain(spark, sf):
    pages = inputs.redirecting_pages(spark, sf)
    moves = navigation.redirect_moves(extract.client_redirect(extract.redirect_nodes(pages)), inputs.pages(spark, sf))
    return navigation.follow_redirects(inputs.pages(spark, sf).select("page_id", "url"), moves).select("page_id", "final_url", "hops")


@query
def redirect_pages(spark, sf):
    """The pages that redirects lead to, in place of those that declare them."""
    rows = navigation.replaced_pages(inputs.redirecting_pages(spark, sf))
    return rows.select("page_id", "url", "hops", F.md5("html").alias("digest"))


@query
def search_hits(spark, sf):
    return navigation.search_hits(extract.page_links(inputs.search_pages(spark, sf)))


# -- rules


@query
def domain_rules(spark, sf):
    ruleset = page_io.rules_df(spark, HEADER_RULES, "rule_no int, domains array<string>, values map<string,string>")
    own = F.when(F.col("page_id") % 3 == 0, F.create_map(F.lit("X-Any"), F.lit("own")))
    asked = inputs.pages(spark, sf).select(F.col("page_id").alias("request_id"), "url", own.alias("headers"))
    return rules.apply_header_rules(asked, ruleset).select("request_id", F.explode("headers").alias("header", "value"))


@query
def auth_profiles(spark, sf):
    profiles = page_io.rules_df(spark, AUTH_PROFILES, "name string, header string, value string, value_prefix string, domains array<string>")
    profile = F.when(F.col("page_id") % 4 == 0, "com").when(F.col("page_id") % 4 == 1, "net").when(F.col("page_id") % 4 == 2, "nobody")
    asked = inputs.pages(spark, sf).select(
        F.col("page_id").alias("request_id"), "url", profile.alias("auth_profile"), F.create_map().cast("map<string,string>").alias("headers"))
    done = rules.apply_auth_profiles(asked, profiles)
    return done.select("request_id", "code", F.col("headers")["Authorization"].alias("auth"), F.col("headers")["X-Key"].alias("x_key"))


@query
def response_kinds(spark, sf):
    types = F.array(*[F.lit(t) for t in CONTENT_TYPES])[(F.col("page_id") % len(CONTENT_TYPES)).cast("int")]
    rows = inputs.pages(spark, sf).withColumn("ct", types)
    return rows.select(
        "page_id", mime.mime_base("ct").alias("mime"), mime.is_text_mime(mime.mime_base("ct")).alias("is_text"),
        mime.is_feed_mime(mime.mime_base("ct", "")).alias("is_feed"), mime.charset_of("ct").alias("charset"),
        mime.route("ct", "html").alias("kind"), mime.binary_placeholder("ct", F.octet_length("html")).alias("note"))


@query
def error_codes(spark, sf):
    kinds = ["timeout", "connect", "redirect", "status", "bad_url", "other"]
    rows = inputs.events(spark, sf).select(inputs._pick(kinds, F.col("k") % 6).alias("kind"), "k")
    code = mime.classify_error("kind")
    mode = mime.fetch_mode(F.when(F.col("k") % 4 == 0, "u"), F.when(F.col("k") % 4 < 2, 1), F.when(F.col("k") % 4 < 3, "t"))
    limit = mime.merge_options(F.when(F.col("k") % 2 == 0, F.col("k")), F.lit(1000))
    return rows.groupBy(code.alias("code"), mime.is_retryable(code).alias("retryable"), mode.alias("mode")).agg(
        F.count("*").alias("n"), F.sum(limit).alias("limits"))


# -- text


@query
def token_estimates(spark, sf):
    return inputs.documents(spark, sf).groupBy("lang", "source").agg(
        F.sum(text.estimate_tokens("text")).alias("tokens"), F.max(text.estimate_tokens("text")).alias("max_tokens"))


@query
def normalize_ws(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", F.md5(text.normalize_ws("text")).alias("digest"))


@query
def collapse_ws(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", F.md5(text.collapse_ws("text")).alias("digest"))


@query
def decode_entities(spark, sf):
    return inputs.pages(spark, sf).select(
        "page_id", F.md5(text.decode_entities("html")).alias("digest"), F.octet_length(text.decode_entities("html")).alias("bytes"))


@query
def clean_html_text(spark, sf):
    return inputs.pages(spark, sf).select(
        "page_id", F.md5(text.clean_description("html")).alias("digest"), F.octet_length(text.strip_tags("html")).alias("bytes"))


@query
def chunk_tokens(spark, sf):
    rows = inputs.documents(spark, sf).select("doc_id", F.col("text"), text.chunk_tokens("text", 100).alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n_chunks"), (F.array_join("chunks", "") == F.col("text")).alias("lossless"),
                       F.array_max(F.transform("chunks", F.octet_length)).alias("max_bytes"))


@query
def chunk_rows(spark, sf):
    rows = markdown.chunks(inputs.documents(spark, sf).select("doc_id", "lang", "text"), "text", 250)
    return rows.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.sum(F.octet_length("chunk")).alias("bytes"))


@query
def truncate_tokens(spark, sf):
    page = text.truncate_tokens("text", F.lit(20), F.lit(60))
    return inputs.documents(spark, sf).select("doc_id", page.alias("p")).select(
        "doc_id", "p.tokens_est", "p.truncated", "p.next_offset", F.md5("p.markdown").alias("digest"))


@query
def strip_controls(spark, sf):
    return inputs.documents(spark, sf).select("doc_id", F.md5(text.strip_dangerous("text")).alias("digest"))


@query
def base64_round_trip(spark, sf):
    encoded = text.b64_encode("text")
    return inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(encoded).alias("digest"), (text.b64_decode(encoded) == F.col("text")).alias("same"))


@query
def sql_functions(spark, sf):
    sqlnames.register(spark)
    inputs.pages(spark, sf).createOrReplaceTempView("pagewright_pages")
    return spark.sql("""
        SELECT page_id, pw_tokens(html) AS tokens, pw_origin(url) AS origin, pw_mime_base('text/html; x=1') AS mime,
               pw_domain_matches('*.example.com', pw_host(url)) AS in_com, md5(pw_clean(html)) AS digest
        FROM pagewright_pages""")


# -- feeds


@query
def feed_items(spark, sf):
    rows = feeds.feed_items(feeds.feed_rows(inputs.document_feeds(spark, sf)))
    return rows.select(F.col("page_id").alias("doc_id"), "idx", "title", "link", "category", F.md5("description").alias("digest"))


@query
def feed_channels(spark, sf):
    return feeds.feeds(feeds.feed_rows(inputs.document_feeds(spark, sf))).select(
        F.col("page_id").alias("doc_id"), "title", "description")


@query
def feed_markdown(spark, sf):
    rows = feeds.feed_markdown(feeds.feed_rows(inputs.document_feeds(spark, sf)))
    return rows.select(F.col("page_id").alias("doc_id"), "title", "tokens_est", F.md5("markdown").alias("digest"))


@query
def feed_links(spark, sf):
    rows = feeds.feed_links(feeds.feed_rows(inputs.document_feeds(spark, sf)))
    return rows.groupBy(F.col("page_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max("i").alias("last_i"), F.min("href").alias("first_href"))


# -- forms and tables


@query
def form_fields(spark, sf):
    fields = forms.form_fields(forms.form_nodes(inputs.customer_forms(spark, sf)))
    return fields.select(F.col("page_id").alias("c_custkey"), "name", "value")


@query
def submit_requests(spark, sf):
    nodes = checkpointed(forms.form_nodes(inputs.customer_forms(spark, sf)))  # four steps read them
    found = forms.extract_forms(nodes)
    checked = forms.validate_fields(nodes, [("textarea", "filled & sent"), ("[name=empty]", "é")])
    fields = forms.fill(forms.form_fields(nodes), found, checked.filter("code IS NULL").select("page_id", "ord", "name", "value"))
    return forms.submit_requests(found, fields).select(F.col("page_id").alias("c_custkey"), "url", "method", "body")


@query
def field_checks(spark, sf):
    """Fields named through an element around the form: a control, an option, and nothing."""
    around = F.concat(F.lit('<div class="login">'), "html", F.lit("</div>"))
    wanted = [("div.login input", "x"), ("div.login option", "y"), ("div.other input", "z")]
    nodes = forms.form_nodes(inputs.customer_forms(spark, sf).withColumn("html", around), [s for s, _ in wanted])
    return forms.validate_fields(nodes, wanted).select(F.col("page_id").alias("c_custkey"), "ord", "name", "code")


@query
def field_values(spark, sf):
    nodes = forms.form_nodes(inputs.customer_forms(spark, sf))
    overlay = inputs.table(spark, sf, "customer").filter("c_nationkey < 5").select(
        F.col("c_custkey").alias("page_id"), F.lit("input[name='name']").alias("key"), F.lit("typed").alias("value"))
    rows = forms.field_values(nodes, overlay)
    return rows.select(F.col("page_id").alias("c_custkey"), "key", "value")


@query
def click_targets(spark, sf):
    nodes = dom.html_nodes(inputs.customer_forms(spark, sf), ("form", "input"), kinds=("element",))
    return selectors.click_target(nodes, "form, input").groupBy("action", "target").agg(F.count("*").alias("n"))


@query
def table_text(spark, sf):
    rows = extract.page_tables(inputs.nation_tables(spark, sf))
    return extract.table_text(rows).select(F.col("page_id").alias("c_custkey"), "content")


# -- secrets


@query
def redact_docs(spark, sf):
    patterns = secrets.secret_patterns(TOKEN_PATTERN)
    docs = secrets.redact_text(inputs.documents(spark, sf).select("doc_id", "text"), "text", patterns)
    return docs.select("doc_id", F.md5("text").alias("digest"))


@query
def vault(spark, sf):
    return secrets.build_vault(inputs.documents(spark, sf), "text", secrets.secret_patterns(TOKEN_PATTERN))


@query
def resolve_docs(spark, sf):
    patterns = secrets.secret_patterns(TOKEN_PATTERN)
    docs = inputs.documents(spark, sf).select("doc_id", "text")
    back = secrets.resolve_handles(secrets.redact_text(docs, "text", patterns), "text", secrets.build_vault(docs, "text", patterns), "doc_id")
    return back.select("doc_id", F.md5("text").alias("digest"))


@query
def redact_marked(spark, sf):
    """Texts with a noncharacter around them and a pattern with a named group: what is hidden comes back unchanged."""
    patterns = secrets.secret_patterns([*TOKEN_PATTERN, ("named", "(?P<my_name>MARK-[A-Z]{4})")])
    mark = F.lit("\ufdd0")
    docs = inputs.documents(spark, sf).select("doc_id", F.concat(mark, "text", mark, F.lit(" MARK-ABCD "), mark, F.lit(" end")).alias("text"))
    hidden = secrets.redact_text(docs.withColumn("whole", F.col("text")), "text", patterns).withColumn("hidden", F.col("text"))
    back = secrets.resolve_handles(hidden, "text", secrets.build_vault(docs, "text", patterns), "doc_id")
    return back.select("doc_id", F.md5("hidden").alias("digest"), (F.col("text") == F.col("whole")).alias("same"))


@query
def redact_cookies(spark, sf):
    jar = cookies.cookie_jar(inputs.cookie_events(spark, sf))
    rows = secrets.redact_cookies(jar)
    return rows.select("session", "domain", "path", "name", "value", "handle")


@query
def redact_storage(spark, sf):
    patterns = secrets.secret_patterns([("value", "v[0-9]*7")])
    rows = secrets.redact_storage(storage.storage_state(inputs.storage_events(spark, sf)), patterns, single=True)
    return rows.select("session", "origin", "key", "value", "handle")


# -- cookies and storage


@query
def cookie_jar(spark, sf):
    return cookies.cookie_jar(inputs.cookie_events(spark, sf)).select(
        "session", "domain", "path", "name", "value", "secure", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query
def cookie_list(spark, sf):
    jar = cookies.cookie_jar(inputs.cookie_events(spark, sf))
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return cookies.list_cookies(jar, as_of, "*.a.example").groupBy("session").agg(F.count("*").alias("n"))


@query
def cookie_header(spark, sf):
    return cookies.cookie_header(inputs.cookie_requests(spark, sf), inputs.cookie_events(spark, sf)).select("session", "seq", "cookie")


@query
def cookie_deletes(spark, sf):
    return cookies.deleted_flags(inputs.cookie_events(spark, sf))


@query
def cookie_export(spark, sf):
    jar = cookies.cookie_jar(inputs.cookie_events(spark, sf))
    back = cookies.import_jar(cookies.export_jar(jar))
    return back.groupBy("session").agg(F.count("*").alias("n"), F.max("value").alias("last_value"))


@query
def set_cookie_lines(spark, sf):
    line = F.concat(F.lit("id="), F.col("c_name"), F.lit("; Domain=.Shop.example; Path=/x; Max-Age="), F.col("c_nationkey").cast("string"), F.lit("; HttpOnly"))
    return inputs.table(spark, sf, "customer").select("c_custkey", cookies.parse_set_cookie(line).alias("c")).select(
        "c_custkey", "c.value", "c.domain", "c.path", "c.max_age", "c.secure", "c.http_only")


@query
def storage_state(spark, sf):
    return storage.storage_state(inputs.storage_events(spark, sf))


@query
def storage_asof(spark, sf):
    return storage.storage_get(inputs.storage_events(spark, sf))


@query
def storage_list(spark, sf):
    rows = storage.storage_list(storage.storage_state(inputs.storage_events(spark, sf)))
    return rows.select("session", "origin", F.to_json("entries").alias("entries"), "count")


@query
def storage_deletes(spark, sf):
    return storage.storage_deletes(inputs.storage_events(spark, sf))


@query
def storage_clears(spark, sf):
    return storage.storage_clears(inputs.storage_events(spark, sf))


@query
def storage_origin(spark, sf):
    visits = history.current_page(_positions(spark, sf))
    rows = storage.with_origin(visits.select("session", "seq", "current_url", F.lit(None).cast("string").alias("origin")))
    return rows.groupBy("origin", "storage_code").agg(F.count("*").alias("n"))


@query
def snapshot_merge(spark, sf):
    state = storage.storage_state(inputs.storage_events(spark, sf))
    return storage.merge_snapshot([("https://o0.example", "key1", "preset"), ("https://new.example", "k", "v")], state)


@query
def snapshot_round_trip(spark, sf):
    key = bytes(range(32))
    entries = history.history(_positions(spark, sf))
    saved = entries.groupBy("session").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("index", "url", "title", "status"))),
                    lambda h: F.struct(h["url"].alias("url"), h["title"].alias("title"), h["status"].alias("status"))).alias("history"),
        F.max(F.when(F.col("current"), F.col("index"))).alias("history_index"))
    snapshots = saved.withColumns({"cookies_json": F.lit("[]"), "storage": F.create_map().cast("map<string,map<string,string>>")})
    loaded = page_io.decrypt_snapshots(page_io.encrypt_snapshots(snapshots, key), key)
    return history.restored_history(loaded).select("session", "index", "url", "title", "current")


# -- history


def _positions(spark, sf):
    return checkpointed(history.history_positions(inputs.history_events(spark, sf)))


@query
def history_fold(spark, sf):
    return history.history_positions(inputs.history_events(spark, sf)).select("session", "seq", "cursor", "length", "code")


@query
def history_entries(spark, sf):
    rows = history.history(_positions(spark, sf))
    return rows.select("session", "index", "url", "title", "current")


@query
def history_search(spark, sf):
    rows = history.history(_positions(spark, sf))
    return history.history_search(rows, "PURCHASE/1", 3).select("session", "index", "url", "count", "total")


@query
def current_page(spark, sf):
    rows = history.current_page(_positions(spark, sf))
    return rows.select("session", "seq", "current_url")


@query
def session_info(spark, sf):
    positions = _positions(spark, sf)
    counts = cookies.cookie_counts(cookies.cookie_jar(inputs.cookie_events(spark, sf)), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return history.session_info(positions, counts)


@query
def links_of_current(spark, sf):
    rows = inputs.events(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("last"))
    now = rows.select(F.col("user_id").alias("session"), F.floor(F.col("last") / 40).alias("page_id"))
    return navigation.links_of_current(now, extract.page_links(navigation.asked_pages(inputs.pages(spark, sf), now))).select("session", "pos", "text", "count")


# -- command logs


def _checked(spark, sf):
    return commands.check_commands(inputs.command_lines(spark, sf))


@query
def parse_commands(spark, sf):
    rows = commands.parse_commands(inputs.command_lines(spark, sf))
    return rows.select("log", "line_no", F.when(~F.col("bad"), F.col("action")).alias("action"), "bad")


@query
def seq_validate(spark, sf):
    rows = commands.validate_seq(commands.parse_commands(inputs.command_lines(spark, sf)))
    return rows.select("log", "line_no", "accepted", "reply_seq")


@query
def quit_cut(spark, sf):
    return _checked(spark, sf).groupBy("log").agg(F.count("*").alias("rows"), F.max("line_no").alias("last_line"))


@query
def action_counts(spark, sf):
    return commands.action_counts(_checked(spark, sf).filter("NOT bad"))


@query
def result_envelopes(spark, sf):
    rows = commands.envelope(_checked(spark, sf), commands.control_data())
    return rows.select("log", "line_no", "ok", "seq", "code", "retryable", "json")


def _results(checked):
    """Results of a log in which storage writes were never answered and link lists twice."""
    checked = checked.filter("NOT bad AND action <> 'storage_set'")
    done = commands.envelope(checked)
    again = commands.envelope(checked.filter("action = 'links'")).withColumn("line_no", F.col("line_no") + 1_000_000_000)
    return done.unionByName(again)


@query
def unanswered(spark, sf):
    checked = checkpointed(_checked(spark, sf))
    return commands.unanswered(checked.filter("NOT bad").select("log", "id", "seq", "line_no"), _results(checked))


@query
def match_results(spark, sf):
    checked = checkpointed(_checked(spark, sf))
    asked = checked.filter("NOT bad").select("log", "id", "seq", "action")
    return commands.match_results(asked, _results(checked)).groupBy("action", "ok", "result_code").agg(F.count("*").alias("n"))


@query
def dedup_retries(spark, sf):
    return commands.dedup_retries(_results(checkpointed(_checked(spark, sf)))).groupBy("log").agg(F.count("*").alias("n"), F.max("line_no").alias("last_line"))


@query
def error_counts(spark, sf):
    return commands.error_counts(commands.envelope(_checked(spark, sf)))
