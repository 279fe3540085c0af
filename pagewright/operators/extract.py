"""Page-level extraction over node rows: titles, metadata, links, content selectors, sections, tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions.urls import absolute_href, display_href, meta_refresh_target
from pagewright.operators.dom import clustered, html_nodes, node_tokens, text_bytes, with_text
from pagewright.operators.selectors import (
    before, by_page, css_flag, from_parent, inside, nearest, parse_selector, siblings, up_to_here)

# The content areas that are looked for, in this order.
CONTENT_SELECTORS = [
    "main", "article", '[role="main"]', "#content", "#main-content", "#mw-content-text",
    ".post-content", ".entry-content", ".article-body",
]
MIN_SECTION_TOKENS = 500
# Script texts that hint at a page moving elsewhere.
REDIRECT_WORDS = ["location.href", "location.replace", "location.assign", "location =", "location=",
                  "window.location", "document.location"]
# Fixed value: the text that is given in place of a page with content areas.
SELECTORS_NOTICE = (
    "Page has content sections. Re-fetch with a `selector` for targeted content, or set "
    "`show_selectors_first=false` for the raw page.")
TRIM = r"(?U)\A\s+|\s+\z"


def trim_ws(s: Column) -> Column:
    return F.regexp_replace(s, TRIM, "")


def info_aggregates() -> list[Column]:
    """Aggregates over the node rows of a page; `info_columns` turns them into page fields."""
    def attr(name: str) -> Column:
        return F.col("attrs")[name]

    def of(tag: str, value: Column) -> Column:
        return F.when(F.col("tag") == tag, value)

    def first(value: Column, flag: Column) -> Column:
        return F.min_by(F.when(flag, F.struct(value.alias("v"))), F.when(flag, F.col("node_id")))["v"]

    def last(value: Column, flag: Column) -> Column:
        return F.max_by(F.when(flag, F.struct(value.alias("v"))), F.when(flag, F.col("node_id")))["v"]

    meta = F.col("tag") == "meta"
    is_type = meta & (F.lower(attr("http-equiv")) == "content-type")
    has_charset = meta & attr("charset").isNotNull()
    return [
        F.first("url", ignorenulls=True).alias("url"),
        F.nullif(trim_ws(first(F.col("text"), F.col("tag") == "title")), F.lit("")).alias("title"),
        first(attr("lang"), F.col("tag") == "html").alias("lang"),
        last(attr("content"), meta & (F.lower(attr("name")) == "description")).alias("description"),
        last(attr("content"), is_type).alias("_type"), F.max(F.when(is_type, F.col("node_id"))).alias("_type_at"),
        first(attr("charset"), has_charset).alias("_charset"),
        last(attr("charset"), has_charset).alias("_late_charset"),
        F.max(F.when(has_charset, F.col("node_id"))).alias("_charset_at"),
        F.max(F.when(F.col("kind") == "document", attr("content_bytes"))).cast("bigint").alias("content_bytes"),
        F.coalesce(F.min_by(of("body", text_bytes()), of("body", F.col("node_id"))), F.lit(0)).alias("_bytes"),
    ]


def info_columns() -> dict[str, Column]:
    # A charset counts only while no content type is set. An http-equiv without content clears the
    # type again, and then only a charset from there on can set it.
    charset = F.when(F.col("_type_at").isNull(), F.col("_charset")).when(
        F.col("_charset_at") >= F.col("_type_at"), F.col("_late_charset"))
    return {
        "content_type": F.coalesce(F.col("_type"), F.concat(F.lit("text/html; charset="), charset)),
        "page_tokens": F.floor(F.col("_bytes") / 4).cast("bigint"),
    }


def page_info(nodes: DataFrame) -> DataFrame:
    """(page_id, url, title, lang, description, content_type, content_bytes, page_tokens).

    Needs rows of `title` (with text), `html`, `meta`, `body` and the document row. Pages arrive
    whole in one partition, so the map-side combine leaves one row per page to shuffle.
    """
    return nodes.groupBy("page_id").agg(*info_aggregates()).withColumns(info_columns()).drop(
        "_type", "_type_at", "_charset", "_late_charset", "_charset_at", "_bytes")


INFO_TAGS = ("title", "html", "meta", "body")


def page_titles(pages: DataFrame) -> DataFrame:
    return page_info(html_nodes(pages, ("title",), texts=("title",))).select("page_id", "title")


def page_metadata(pages: DataFrame) -> DataFrame:
    return page_info(html_nodes(pages, ("html", "meta"))).select("page_id", "lang", "description", "content_type")


def page_tokens(pages: DataFrame) -> DataFrame:
    return page_info(html_nodes(pages, ("body",))).select("page_id", "page_tokens")


def page_summary(pages: DataFrame) -> DataFrame:
    return page_info(html_nodes(pages, INFO_TAGS, texts=("title",)))


def link_nodes(pages: DataFrame) -> DataFrame:
    return html_nodes(pages, ("a", "img"), kinds=("element",), texts=("a",))


def with_links(nodes: DataFrame) -> DataFrame:
    """Node rows with `_link` on every anchor that counts as a link: struct(i, text, href, raw_href).

    `i` counts all `a[href]` of the page and so has gaps: anchors without a label are dropped, and
    of several with the same address the first stays. `a` rows carry their text; `img` rows must
    be present for the label fallback.
    """
    attrs = F.col("attrs")
    image = F.struct("node_id", attrs["alt"].alias("alt"))
    next_image = F.last(F.when(F.col("tag") == "img", image), ignorenulls=True).over(
        before(by_page(F.desc("node_id"))))
    anchor = F.coalesce((F.col("tag") == "a") & F.map_contains_key(attrs, "href"), F.lit(False))
    # aria-label counts only where title is absent
    label = F.nullif(trim_ws(F.coalesce(attrs["title"], attrs["aria-label"])), F.lit(""))
    has_image = F.col("_img.node_id") <= F.col("end_id")
    alt = F.when(has_image, F.coalesce(F.nullif(trim_ws(F.col("_img.alt")), F.lit("")), F.lit("img")))
    text = F.when(F.col("_a"), F.coalesce(F.nullif(trim_ws(F.col("text")), F.lit("")), label, alt))
    number = F.row_number().over(Window.partitionBy("page_id", "_a").orderBy("node_id")) - 1
    nth = F.row_number().over(Window.partitionBy("page_id", "_href").orderBy("node_id"))
    rows = nodes.withColumn("_img", next_image).withColumn("_a", anchor).withColumn("_i", number).withColumn("_text", text)
    rows = rows.withColumn("_href", F.when(F.col("_text").isNotNull(), display_href("url", attrs["href"])))
    kept = F.col("_text").isNotNull() & ((F.col("_nth") == 1) | (F.col("_href") == ""))
    return rows.withColumn("_nth", nth).withColumn("_link", F.when(kept, F.struct(
        F.col("_i").cast("int").alias("i"), F.col("_text").alias("text"), F.col("_href").alias("href"),
        attrs["href"].alias("raw_href")))).drop("_img", "_a", "_i", "_text", "_href", "_nth")


def extract_links(nodes: DataFrame) -> DataFrame:
    """(page_id, url, i, pos, text, href, raw_href): `pos` is dense and is what following by index
    uses."""
    links = with_links(nodes.filter(F.col("kind") == "element")).filter(F.col("_link").isNotNull())
    return links.withColumn("pos", (F.row_number().over(by_page()) - 1).cast("int")).select(
        "page_id", "url", "_link.i", "pos", "_link.text", "_link.href", "_link.raw_href")


def page_links(pages: DataFrame) -> DataFrame:
    return extract_links(link_nodes(pages))


# -- content selectors, outlines and sections


def heading_level(tag="tag") -> Column:
    return F.when(F.col(tag).rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))


def with_sections(rows: DataFrame) -> DataFrame:
    """Add `_stop_id`, `section_to` and `section_bytes` to heading rows (null on others).

    A section runs over the siblings after its start (the heading, or the `div` that wraps it) up
    to the first one that is, or directly holds, a heading of the same or a higher level, else to
    the end of the parent. Only rows with a `heading` level take part, and no heading is paired
    with its siblings: one backward window finds the next boundary for each of the six levels.
    """
    wraps = (F.col("tag") == "div") & F.exists(
        F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c.startswith("mw-heading"))
    boundary = F.struct("sib", "node_id", "text_from")
    stops = F.array(*[F.min(F.when(F.col("heading") <= n, boundary)).over(before(siblings(F.desc("sib"))))
                      for n in range(1, 7)])
    start = F.struct("node_id", "text_to", "parent_end", "parent_to", F.col("_stops").alias("stops"))
    # A heading or what wraps it has a level; other rows do not carry the boundaries along.
    has_level = F.col("heading").isNotNull()
    rows = rows.withColumn("_stops", F.when(has_level, stops)).withColumn("_own", F.when(has_level, start))
    rows = from_parent(rows, F.when(wraps, F.col("_own")), "_wrapper")
    rows = rows.withColumn("_start", F.when(heading_level().isNotNull(), F.coalesce("_wrapper", "_own")))
    rows = rows.withColumn("_stop", F.col("_start.stops")[heading_level() - 1])
    return rows.withColumns({
        "_stop_id": F.coalesce(F.col("_stop.node_id") - 1, F.col("_start.parent_end")),
        "section_to": F.coalesce(F.col("_stop.text_from"), F.col("_start.parent_to")),
    }).withColumn("section_bytes", F.col("section_to") - F.col("_start.text_to")).drop(
        "_stops", "_own", "_wrapper", "_stop")


def section_extent(nodes: DataFrame) -> DataFrame:
    """(page_id, heading_id, start_id, level, tag, attrs, text, stop_id, section_to, section_bytes)
    for every heading: `stop_id` is the last node of its section, `section_bytes` the text size
    after the heading."""
    rows = clustered(nodes.filter(F.col("heading").isNotNull()))
    return with_sections(rows).filter(F.col("_start").isNotNull()).select(
        "page_id", F.col("node_id").alias("heading_id"), F.col("_start.node_id").alias("start_id"),
        heading_level().alias("level"), "tag", "attrs", "text", F.col("_stop_id").alias("stop_id"),
        "section_to", "section_bytes")


def outline(nodes: DataFrame, min_tokens: int = MIN_SECTION_TOKENS) -> DataFrame:
    """(page_id, node_id, selector, tokens_est, label) of `h2[id]` and `h3[id]` sections.

    Heading rows must carry their text (`texts=("h2", "h3")` in `html_nodes`).
    """
    label = trim_ws(F.col("text"))
    return (section_extent(nodes).filter(F.col("tag").isin("h2", "h3") & F.map_contains_key("attrs", "id"))
            .withColumn("tokens_est", F.floor(F.col("section_bytes") / 4).cast("bigint"))
            .filter((label != "") & (F.col("tokens_est") >= min_tokens))
            .select("page_id", F.col("heading_id").alias("node_id"),
                    F.concat(F.lit("#"), F.col("attrs")["id"]).alias("selector"), "tokens_est",
                    label.alias("label")))


def _static_tests() -> list[Column]:
    return [parse_selector(selector)[0][0].test for selector in CONTENT_SELECTORS]


def _is_body_part() -> Column:
    return F.coalesce((F.col("parent_tag") == "body") & F.map_contains_key("attrs", "id"), F.lit(False))


def is_candidate() -> Column:
    """Rows that `candidate_entries` can use; everything else need not be shuffled."""
    flag = _is_body_part() | F.col("heading").isNotNull()
    for test in _static_tests():
        flag = flag | test
    return flag


def candidate_entries(min_tokens: int = MIN_SECTION_TOKENS) -> Column:
    """array<struct(part, ord, selector, tokens_est, label)>: what a row of `with_sections` may
    contribute. Part 0 are content areas (static candidates, then ids), part 1 are sections."""
    null_label = F.lit(None).cast("string")

    def entry(part: int, order: Column, selector: Column, tokens: Column, label: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), order.cast("int").alias("ord"), selector.alias("selector"),
                        tokens.alias("tokens_est"), label.alias("label"))

    id_selector = F.concat(F.lit("#"), F.col("attrs")["id"])
    entries = [F.when(test, entry(0, F.lit(n), F.lit(selector), node_tokens(), null_label))
               for n, (selector, test) in enumerate(zip(CONTENT_SELECTORS, _static_tests()))]
    entries.append(F.when(_is_body_part() & (node_tokens() >= min_tokens), entry(
        0, F.col("node_id") + len(CONTENT_SELECTORS), id_selector, node_tokens(), null_label)))
    section_tokens = F.floor(F.col("section_bytes") / 4).cast("bigint")
    heading = trim_ws(F.col("text"))
    entries.append(F.when(
        F.col("tag").isin("h2", "h3") & id_selector.isNotNull() & (heading != "") & (section_tokens >= min_tokens),
        entry(1, F.col("node_id"), id_selector, section_tokens, heading)))
    return F.array_compact(F.array(*entries))


def chosen_entries(rows: DataFrame, entry: str, min_tokens: int) -> DataFrame:
    """Add `_chosen`: the entry is the first match of its candidate, large enough, and the first
    name under which its element is listed."""
    first = Window.partitionBy("page_id", f"{entry}.part", f"{entry}.ord").orderBy("node_id")
    large = (F.col("_first") == 1) & (F.col(f"{entry}.tokens_est") >= min_tokens)
    once = Window.partitionBy("page_id", f"{entry}.part", "node_id", "_large").orderBy(f"{entry}.ord")
    return (rows.withColumn("_first", F.row_number().over(first)).withColumn("_large", large)
            .withColumn("_chosen", F.col("_large") & (F.row_number().over(once) == 1)).drop("_first", "_large"))


def entry_order(entry: str) -> list[Column]:
    """Areas by size (then as found), after them sections in document order."""
    e = F.col(entry)
    return [e["part"], F.when(e["part"] == 0, -e["tokens_est"]).otherwise(0), e["ord"]]


def content_selectors(nodes: DataFrame, min_tokens: int = MIN_SECTION_TOKENS) -> DataFrame:
    """(page_id, rank, selector, tokens_est, label) of each page's content areas and sections.

    Only rows that can become an entry leave the parse, and they are shuffled once.
    """
    rows = with_sections(clustered(nodes.filter((F.col("kind") == "element") & is_candidate())))
    found = rows.select("page_id", "node_id", F.explode(candidate_entries(min_tokens)).alias("e"))
    return (chosen_entries(found, "e", min_tokens).filter("_chosen")
            .withColumn("rank", F.row_number().over(by_page(*entry_order("e"))))
            .select("page_id", "rank", "e.selector", "e.tokens_est", "e.label"))


def content_nodes(pages: DataFrame) -> DataFrame:
    """Node rows for content selectors and sections: all elements, headings with text. Text rows
    are not needed, since every element knows the byte range of its text."""
    return html_nodes(pages, kinds=("element",), texts=("h2", "h3"), page_text=False)


def section_text(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, content): text of every match, headings taken with their section, in document
    order and joined by blank lines. `nodes` must hold the whole page text."""
    flagged = css_flag(nodes, selector, "_hit", keep_others=True).filter(
        F.col("_hit") | F.col("heading").isNotNull() | (F.col("kind") == "document"))
    rows = with_sections(clustered(flagged)).withColumn(
        "text_to", F.when(F.col("_hit") & F.col("_start").isNotNull(), F.col("section_to")).otherwise(F.col("text_to")))
    parts = with_text(rows.select("page_id", "node_id", "kind", "text", "text_from", "text_to", "_hit"), F.col("_hit"), "part")
    ordered = F.array_sort(F.collect_list(F.struct("node_id", "part")))
    return parts.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda r: trim_ws(r["part"])), "\n\n").alias("content"))


# -- tables

TABLE_TAGS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th")


def extract_tables(nodes: DataFrame) -> DataFrame:
    """(page_id, table_id, row_no, is_header, cells): rows of outermost tables in document order.

    `nodes` holds TABLE_TAGS rows, cells with their text; see `page_tables`. A row below a cell
    belongs to the outermost row's cell text, not to the table.
    """
    is_table = F.col("tag") == "table"
    rows = nodes.filter(F.col("kind") == "element")
    rows = rows.withColumn("_top", is_table & ~inside(is_table))
    rows = nearest(rows, F.col("_top"), "table_id")
    rows = rows.filter(F.col("table_id").isNotNull())
    rows = rows.withColumn("_top_row", (F.col("tag") == "tr") & ~inside(F.col("tag") == "tr"))
    head_state = F.last(F.when(F.col("tag").isin("thead", "tbody", "tfoot"), F.struct("tag", "end_id")),
                        ignorenulls=True).over(up_to_here(by_page()))
    rows = rows.withColumn("_sec", head_state)
    in_head = F.coalesce((F.col("_sec.tag") == "thead") & (F.col("_sec.end_id") >= F.col("node_id")), F.lit(False))
    rows = rows.withColumn("_row_id", F.when(F.col("_top_row"), F.col("node_id")).when(
        F.col("tag").isin("td", "th"), F.col("parent_id")))
    is_cell = F.col("tag").isin("td", "th")
    text = F.regexp_replace(trim_ws(F.col("text")), r"(?U)\s+", " ")
    cells = F.array_sort(F.collect_list(F.when(is_cell, F.struct("node_id", text.alias("c")))))
    grouped = rows.filter(F.col("_row_id").isNotNull()).groupBy("page_id", "_row_id").agg(
        F.max(F.when(F.col("_top_row"), F.col("table_id"))).alias("table_id"),
        F.max(F.when(F.col("_top_row"), in_head)).alias("_in_head"),
        F.coalesce(F.max(F.col("tag") == "th"), F.lit(False)).alias("_has_th"), cells.alias("_cells"))
    order = Window.partitionBy("page_id", "table_id").orderBy("_row_id")
    return (grouped.filter(F.col("table_id").isNotNull())
            .select("page_id", "table_id", (F.row_number().over(order) - 1).alias("row_no"),
                    (F.col("_in_head") | F.col("_has_th")).alias("is_header"),
                    F.transform("_cells", lambda c: c["c"]).alias("cells")))


def page_tables(pages: DataFrame) -> DataFrame:
    return extract_tables(html_nodes(pages, TABLE_TAGS, kinds=("element",), texts=("td", "th")))


def table_text(rows: DataFrame) -> DataFrame:
    """(page_id, table_id, content): pipe text, rows padded to the widest, a rule after the headers."""
    whole = Window.partitionBy("page_id", "table_id")
    width = F.max(F.size("cells")).over(whole)
    headers = F.sum(F.col("is_header").cast("int")).over(whole)
    padded = F.concat(F.col("cells"), F.array_repeat(F.lit(""), F.col("_width") - F.size("cells")))
    line = F.concat(F.lit("|"), F.array_join(F.transform(padded, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.col("_width")))
    after = F.greatest(F.col("_headers"), F.lit(1)) == F.col("row_no") + 1
    text = F.concat(line, F.when(after, rule).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("row_no", text.alias("line"))))
    return (rows.withColumn("_width", width).withColumn("_headers", headers).filter("_width > 0")
            .groupBy("page_id", "table_id")
            .agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("content")))


# -- redirects declared by pages


def client_redirect(nodes: DataFrame) -> DataFrame:
    """(page_id, url, target, by_script) for pages that send the reader on.

    Needs `meta` and `script` rows, scripts with text. The first refresh tag wins; otherwise the
    first literal address assigned in a script that mentions a location. Scripts are not run.
    """
    attrs = F.col("attrs")
    refresh = F.when((F.col("tag") == "meta") & (F.lower(attrs["http-equiv"]) == "refresh"),
                     meta_refresh_target(attrs["content"]))
    moves = F.lit(False)
    for word in REDIRECT_WORDS:
        moves = moves | F.col("text").contains(word)
    literal = F.regexp_extract(
        F.col("text"), r"location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]|location\.(?:assign|replace)\(\s*['\"]([^'\"]+)['\"]", 0)
    address = F.nullif(F.regexp_extract(literal, r"['\"]([^'\"]+)['\"]", 1), F.lit(""))
    scripted = F.when((F.col("tag") == "script") & moves, address)
    found = nodes.withColumn("_meta", refresh).withColumn("_script", scripted).groupBy("page_id").agg(
        F.first("url").alias("url"),
        F.min_by("_meta", F.when(F.col("_meta").isNotNull(), F.col("node_id"))).alias("_meta"),
        F.min_by("_script", F.when(F.col("_script").isNotNull(), F.col("node_id"))).alias("_script"),
        F.coalesce(F.max(F.when(F.col("tag") == "script", moves)), F.lit(False)).alias("script_moves"))
    target = F.coalesce("_meta", "_script")
    return (found.filter(target.isNotNull())
            .select("page_id", "url", absolute_href("url", target).alias("target"),
                    F.col("_meta").isNull().alias("by_script")))


def redirect_nodes(pages: DataFrame) -> DataFrame:
    """Rows of the elements that can move a reader on, of the pages that hold such a word at all."""
    return html_nodes(pages.filter(F.col("html").rlike("(?i)http-equiv|location")), ("meta", "script"), texts=("script",))


# -- user functions over one page


def map_dom(nodes: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's Python function over each page's nodes (one page is the group)."""
    def ordered(page: pd.DataFrame) -> pd.DataFrame:
        return fn(page.sort_values("node_id", ignore_index=True))

    return nodes.groupBy("page_id").applyInPandas(ordered, schema)


def result_type(value: Column) -> Column:
    """Type name of a JSON result: undefined, null, boolean, number, string, array or object."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (F.when(value.isNull(), "undefined").when(kind.isNull(), "string").when(kind == "VOID", "null")
            .when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
            .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number"))


