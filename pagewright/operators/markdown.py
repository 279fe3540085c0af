"""Markdown of pages, put together from node rows.

A node gives pieces of text where it opens and where it closes, and wishes for line breaks. What a piece looks like follows
from columns: ancestors known from the parse, the nearest following row that shows anything (is a link, list item or emphasis
empty?), and the first link of an address. Line breaks are a fold over the pieces of a page, of a quotation or of a table:
"at least so many line breaks here" and "so many more" are maps t -> max(t + a, b), which compose, so running sums and a
running maximum grant all wishes at once. A link's pieces are joined first, then the page's, in document order. Everything
runs in windows and aggregates that cluster on `page_id`: one parse, a shuffle before it and one half way (`staged`), no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions.text import chunk_tokens, collapse_ws, decode_entities, normalize_ws, truncate_tokens
from pagewright.functions.urls import display_href
from pagewright.operators.dom import ANCESTORS, COLUMNS, clustered, html_nodes, staged
from pagewright.operators.extract import trim_ws, with_sections
from pagewright.operators.selectors import before, css_flag, up_to_here

# What elements become.
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = ["p", "div", "section", "article", "main", "header", "footer", "nav"]
LISTS = ["ul", "ol"]
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
SHOWN_ATTRS = ["href", "title", "aria-label", "src", "alt"]
HIDDEN = list(ANCESTORS["hidden"][0])
CHROME = list(ANCESTORS["chrome"][0])
CELLS = ["td", "th"]
SHOWN_TAGS = [*HEADINGS, *BLOCKS, *LISTS, *MARKS, "a", "img", "br", "hr", "code", "pre", "blockquote", "li", "table", "tr", *CELLS]
NODE_TAGS = [*SHOWN_TAGS, "#text"]
CONTEXT = ["near_link", "near_quote", "deep_quote", "near_pre", "near_list", "deep_list", "near_ordered", "near_table", "top_table",
           "deep_row", "near_head", "near_hidden", "near_chrome"]
NODE_COLUMNS = ["page_id", "url", "node_id", "end_id", "kind", "tag", "attrs", "text", "parent_tag", *CONTEXT]

# What an event is to the fold: a text, a wish, or a place where the fold of another scope meets this one.
TEXT, LINE, GAP, QUOTE_END, QUOTED, LINK, ROW, ROW_END, CELL = range(9)
PLACE = ["match", "at", "shut", "rev", "sub"]  # order of events: openings by node, closings innermost first
REFS = "array<struct<i:int,text:string,href:string>>"
PIECE = "struct<match:int,at:int,shut:int,rev:int,sub:int,text:string>"


def _here(*order) -> Window:
    return Window.partitionBy("page_id", "match").orderBy(*(order or ("node_id",)))


def _following(flag: Column, value: Column | None = None) -> Column:
    """Of the rows behind this one in document order, the nearest flagged one."""
    return F.last(F.when(flag, F.col("node_id") if value is None else value), ignorenulls=True).over(before(_here(F.desc("node_id"))))


def _holds(following: str) -> Column:
    return F.coalesce(F.col(following) <= F.col("end_id"), F.lit(False))


def _is(*tags: str) -> Column:
    return F.coalesce(F.col("tag").isin(list(tags)), F.lit(False))


def _visible(rows: DataFrame, strip_nav: bool, include_images: bool) -> DataFrame:
    """Rows that may show something, with their own text (`shown`), image address (`src`) and place in a table."""
    is_text, in_table = F.col("kind") == "text", F.col("top_table").isNotNull()
    hidden = F.col("near_hidden").isNotNull() | _is(*HIDDEN)
    if strip_nav:
        hidden = hidden | F.col("near_chrome").isNotNull() | _is(*CHROME)
    is_row = _is("tr") & in_table & (F.col("deep_row") == 0)
    is_cell = _is(*CELLS) & in_table & (F.col("parent_tag") == "tr") & (F.col("deep_row") == 1)
    used = F.col("match").isNotNull() & ~hidden & F.when(in_table, is_row | is_cell).otherwise(is_text | (_is(*SHOWN_TAGS) & ~_is("tr", *CELLS)))
    shown = F.when(is_text, F.when(F.col("near_pre").isNotNull(), F.col("text")).otherwise(collapse_ws("text")))
    src = F.when(_is("img"), F.nullif(F.col("attrs")["src"], F.lit(""))) if include_images else F.lit(None).cast("string")
    rows = rows.withColumns({"_row": is_row, "_cell": is_cell, "_used": used}).withColumns({
        "shown": F.when(F.col("_used"), shown), "src": F.when(F.col("_used"), src)})
    # Is `shown` empty? Asked of the text itself, so that a filter does not repeat all of the above.
    filled = ~is_text | F.coalesce(F.when(F.col("near_pre").isNotNull(), F.col("text") != "").otherwise(F.col("text").rlike(r"(?U)\S")), F.lit(True))
    return rows.filter(F.col("match").isNull() | (F.col("_used") & filled) | F.col("_start"))


def _linked(rows: DataFrame, include_links: bool, compact_links: bool) -> DataFrame:
    """Rows without the links that are not shown, with what the others need: `_link` names a shown link on it and below it,
    `_label` stands for a text without letters or signs, `_number` counts references."""
    none = F.lit(None)
    if not include_links:
        return rows.withColumns({"_link": none.cast("int"), "_head": F.lit(False), "_label": none.cast("string"),
                                 "_href": none.cast("string"), "_number": none.cast("int"), "_outside": F.lit(0)})
    attrs, is_link = F.col("attrs"), F.col("_used") & _is("a")
    says = F.coalesce(F.col("shown").rlike(r"(?U)[^\s*_`]"), F.lit(False)) | (F.col("_used") & (_is("hr") | F.col("src").isNotNull() | F.col("_cell")))
    image = F.struct(F.col("node_id").alias("at"), F.nullif(trim_ws(attrs["alt"]), F.lit("")).alias("alt"))
    says = says | (F.col("_used") & _is("blockquote") & _holds("_room"))
    rows = rows.withColumn("_room", _following(_takes_room())).withColumns({"_says": _following(says), "_image": _following(_is("img"), image)})
    # The label attribute counts only where there is no title.
    own = F.nullif(trim_ws(F.coalesce(attrs["title"], attrs["aria-label"])), F.lit(""))
    pictured = F.when(F.col("_image.at") <= F.col("end_id"), F.coalesce(F.col("_image.alt"), F.lit("img")))
    rows = rows.withColumn("_label", F.when(is_link & ~_holds("_says"), F.coalesce(own, pictured)))
    worthy = is_link & (_holds("_says") | F.col("_label").isNotNull())
    rows = rows.withColumn("_href", F.when(worthy, display_href("url", F.coalesce(attrs["href"], F.lit("")))))
    # A quotation repeats links that were shown outside it.
    once = Window.partitionBy("page_id", F.when(F.col("near_quote").isNotNull(), F.col("match")), "near_quote", "_href").orderBy("match", "node_id")
    rows = rows.withColumn("_nth", F.row_number().over(once)).withColumn(
        "_head", F.coalesce((F.col("_href") == "") | (F.col("_href").isNotNull() & (F.col("_nth") == 1)), F.lit(False)))
    number = none.cast("int")
    if compact_links:
        counted = F.when(F.col("_head") & F.col("near_quote").isNull(), 1)
        number = F.when(counted.isNotNull(), F.count(counted).over(up_to_here(Window.partitionBy("page_id").orderBy("match", "node_id"))) - 1).cast("int")
    rows = rows.withColumns({"_number": number, "_link": F.when(is_link, F.col("node_id")).otherwise(F.col("near_link"))})
    whose = up_to_here(Window.partitionBy("page_id", "match", "_link").orderBy("node_id"))
    # Inside a link only the quotations within it mark lines.
    outside = F.when(F.col("_link").isNotNull() & ~F.col("_head"), F.first("deep_quote").over(whose)).otherwise(0)
    rows = rows.withColumns({"_kept": F.first("_head").over(whose), "_outside": outside})
    # A chosen part keeps its first row, even where that shows nothing itself.
    kept = F.col("match").isNull() | F.col("_link").isNull() | F.col("_kept")
    return rows.withColumn("_used", F.col("_used") & kept).filter(kept | F.col("_start"))


def _solid() -> Column:
    """Does the row itself show more than white space?"""
    marks = (_is("code") & F.col("near_pre").isNull()) | _is("hr", "pre") | F.col("src").isNotNull() | F.col("_cell") | (
        _is(*HEADINGS) & F.col("_link").isNull())
    return F.coalesce(F.col("shown").rlike(r"(?U)\S"), F.lit(False)) | F.col("_head") | (F.col("_used") & marks)


def _takes_room() -> Column:
    """Does the row put anything on the page, were it a line break?"""
    return F.col("shown").isNotNull() | F.col("src").isNotNull() | (F.col("_used") & _is("br", "hr", "table", *BLOCKS, *HEADINGS))


def _filled(rows: DataFrame) -> DataFrame:
    """Rows without empty list items and emphasis, items numbered by their list."""
    rows = rows.withColumns({"_room": _following(_solid() | _takes_room()), "_cells": _following(F.col("_cell"))})
    rows = rows.withColumn("_next", _following(_solid() | (F.col("_used") & _is("blockquote") & _holds("_room"))))
    item = _is("li") & F.col("_used")
    number = F.count(F.when(item, 1)).over(up_to_here(Window.partitionBy("page_id", "match", "near_list").orderBy("node_id")))
    rows = rows.withColumn("_item", F.when(item, number))
    empty = F.col("_used") & _is("li", *MARKS) & ~_holds("_next")
    reach = F.max(F.when(empty, F.col("end_id"))).over(up_to_here(_here()))
    rows = rows.withColumn("_reach", reach)
    kept = F.coalesce("_reach", F.lit(-1)) < F.col("node_id")
    return rows.withColumn("_used", F.col("_used") & kept).filter(F.col("match").isNull() | F.col("_start") | kept)


def _events(rows: DataFrame) -> DataFrame:
    """One row per piece or wish, with its place and its scope: the text is folded by page, quotation or table."""
    tag, in_link = F.col("tag"), F.col("_link").isNotNull() & ~F.col("_head")
    scope = F.when(F.col("_row") | F.col("_cell"), F.col("_table")).when(
        in_link & ~F.coalesce(F.col("near_quote") > F.col("_link"), F.lit(False)), F.col("_link")).otherwise(F.coalesce("near_quote", F.lit(-1)))

    # What a row gives are constants but for one text of its own (null in them), its places and its scope, which follow after
    # the rows are multiplied: as expressions of every event they would make a method too large to be compiled.
    def event(sub: int, what: int, text: str | None = "", shut: int = 0) -> Column:
        return F.struct(F.lit(shut).alias("shut"), F.lit(sub).alias("sub"), F.lit(what).alias("what"), F.lit(text).cast("string").alias("piece"))

    def gives(*events: Column) -> Column:
        return F.array(*events)

    both = gives(event(0, TEXT, None), event(0, TEXT, None, 1))
    nothing = F.slice(gives(event(0, TEXT)), 1, 0)
    quoted = gives(event(0, LINE), event(0, QUOTE_END, "", 1), event(1, QUOTED, "", 1))
    level = F.substring(tag, 2, 1).cast("int")
    mark = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])[tag]
    sign = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("deep_list") - 1, F.lit(0))), F.when(
        F.col("near_ordered").isNotNull(), F.concat(F.col("_item").cast("string"), F.lit(". "))).otherwise("- "))
    picture = F.concat(F.lit("!["), F.coalesce(F.col("attrs")["alt"], F.lit("")), F.lit("]("), display_href("url", F.col("src")), F.lit(")"))
    cell = F.concat(F.lit(" "), trim_ws(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit(" |"))
    is_heading = tag.isin(HEADINGS) & F.col("_link").isNull()
    own = (
        F.when(F.col("shown").isNotNull(), F.col("shown")).when(F.col("_cell"), cell)
        .when(is_heading, F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).when(tag.isin(list(MARKS)), mark)
        .when(tag == "code", "`").when(tag == "li", sign).when(F.col("src").isNotNull(), picture))
    found = (
        F.when(F.col("match").isNull() | ~F.col("_used"), nothing)
        .when(F.col("shown").isNotNull(), gives(event(0, TEXT, None)))
        .when(F.col("_row"), gives(event(0, ROW), event(0, ROW_END, "", 1)))
        .when(F.col("_cell"), gives(event(0, CELL, None)))
        .when(F.col("_head"), gives(event(0, LINK)))
        .when(is_heading, gives(event(0, LINE), event(1, TEXT, None), event(0, TEXT, "\n", 1)))
        .when(tag.isin(BLOCKS), gives(event(0, LINE), event(0, GAP, "", 1)))
        .when(tag == "br", gives(event(0, TEXT, "\n")))
        .when(tag == "hr", gives(event(0, LINE), event(1, TEXT, "---\n")))
        .when(tag.isin(list(MARKS)) | ((tag == "code") & F.col("near_pre").isNull()), both)
        .when(tag == "pre", gives(event(0, LINE), event(1, TEXT, "```\n"), event(0, LINE, "", 1), event(1, TEXT, "```\n", 1)))
        .when(tag == "blockquote", F.when(_holds("_room"), quoted).otherwise(gives(event(0, LINE))))
        .when(tag.isin(LISTS), gives(event(0, LINE), event(0, LINE, "", 1)))
        .when(tag == "li", gives(event(0, LINE), event(1, TEXT, None)))
        .when(F.col("src").isNotNull(), gives(event(0, TEXT, None)))
        .when(tag == "table", gives(event(0, LINE), event(0, QUOTED, "", 1), event(1, TEXT, "\n", 1)))
        .otherwise(nothing))
    # The first row of a chosen part always stands for it; between two of them lies a gap.
    opening = F.when(F.col("match") > 0, gives(event(0, GAP, "", -1))).otherwise(gives(event(0, TEXT, "", -1)))
    events = F.when(F.col("match").isNull() | F.col("_start"), F.concat(opening, found)).otherwise(found)
    closes, opens_part, ends_quote = F.col("_e.shut") == 1, F.col("_e.shut") == -1, F.col("_e.what") == QUOTE_END
    depth = F.col("deep_quote") - F.col("_outside") + F.when(ends_quote, 1).otherwise(0)
    rows = rows.withColumns({"_own_text": F.when(F.col("_used"), own), "_own_scope": scope}).withColumn("_e", F.explode(events))
    rows = rows.withColumns({
        "at": F.when(closes, F.col("end_id")).otherwise(F.col("node_id")), "shut": F.col("_e.shut"),
        "rev": F.when(closes, -F.col("node_id")).otherwise(0), "sub": F.col("_e.sub"), "what": F.col("_e.what"),
        "piece": F.coalesce("_e.piece", "_own_text"), "scope": F.when(opens_part, -1).when(ends_quote, F.col("node_id")).otherwise(F.col("_own_scope")),
        "depth": F.when(opens_part, 0).otherwise(depth)}).drop("_e", "_own_text", "_own_scope", "_reach", "_item", "_next", "_room", "_kept", "_nth")
    return rows.withColumn("scope_match", F.when(F.col("scope") >= 0, F.col("match")))


def _settled(events: DataFrame) -> DataFrame:
    """Events with what they come to (`said`): wishes granted, rows of tables filled up, lines of quotations marked."""
    what, piece = F.col("what"), F.col("piece")
    window = Window.partitionBy("page_id", "scope_match", "scope").orderBy(*PLACE)
    so_far, earlier = up_to_here(window), before(window)
    all_rows = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # How the last thing in front of the end of a quotation ends says whether a line break is due.
    open_end = (what == LINK) | ((what == TEXT) & (piece != "") & ~piece.endswith("\n"))
    does = what.isin(LINE, GAP, LINK, QUOTED) | ((what == TEXT) & (piece != ""))
    in_order = before(Window.partitionBy("page_id", "match").orderBy(*PLACE))
    in_link = F.col("_link").isNotNull() & (F.col("_link") != F.coalesce(F.when(F.col("_head"), F.col("node_id")), F.lit(-1)))

    def last(flag: Column) -> Column:
        return F.last(F.when(does & flag, F.struct("scope", open_end.alias("open"))), ignorenulls=True).over(in_order)

    # To what lies outside it a link is one thing, whatever is below it.
    beside, within = last(~in_link), last(~F.coalesce(F.col("scope") == F.col("_link"), F.lit(False)))
    rows = events.withColumn("_last", F.when(in_link, within).otherwise(beside))
    bare = F.length(F.regexp_replace(piece, r"\n+\z", ""))
    breaks = F.length(piece) - bare
    ended = F.when(_is("table"), F.when(_holds("_cells"), 1)).otherwise(F.when(F.col("_last.open") & (F.col("_last.scope") == F.col("node_id")), 2).otherwise(1))
    ends = F.when(what == LINK, 0).when(what == QUOTED, ended).when((what == TEXT) & (bare > 0), breaks)
    rows = rows.withColumns({"_ends": ends, "_more": F.when((what == TEXT) & (bare == 0), breaks).otherwise(0)})
    cells = F.count(F.when(what == CELL, 1)).over(so_far)
    heads = F.count(F.when((what == CELL) & _is("th"), 1)).over(so_far)
    rows = rows.withColumns({
        "_part": F.count("_ends").over(so_far), "_sum": F.sum("_more").over(so_far), "_c": cells, "_h": heads,
        "_some": F.count(F.when(F.col("_ends").isNotNull() | (F.col("_more") > 0) | (what == GAP), 1)).over(earlier)})
    least = F.when(what == LINE, F.when(F.col("_part") > 0, 1)).when(what == GAP, F.when(F.col("_some") == 0, 1).otherwise(2)).otherwise(F.col("_ends"))
    high = F.max(F.when(least.isNotNull(), F.struct(F.col("_part").alias("part"), (least - F.col("_sum")).alias("v")))).over(so_far)
    opened = F.last(F.when(what == ROW, F.struct("_c", "_h")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"_high": high, "_open": opened})
    stands = F.col("_sum") + F.when(F.col("_part") > 0, F.col("_high.v")).otherwise(F.greatest(F.coalesce("_high.v", F.lit(0)), F.lit(0)))
    width = F.when(what == ROW_END, F.col("_c") - F.col("_open._c"))
    is_head = (what == ROW_END) & (F.col("near_head").isNotNull() | (F.col("_h") > F.col("_open._h")))
    rows = rows.withColumns({"_t": stands, "_w": width, "_is_head": is_head})
    rows = rows.withColumns({
        "_was": F.coalesce(F.lag("_t").over(window), F.lit(0)), "_width": F.max("_w").over(all_rows),
        "_heads": F.count(F.when(F.col("_is_head"), 1)).over(all_rows), "_row_no": F.count(F.when(what == ROW_END, 1)).over(so_far)})

    sign = F.repeat(F.lit("> "), F.col("depth"))
    lead = F.when((F.col("_was") >= 1) | (F.col("_some") == 0), sign).otherwise("")
    rule = F.when(F.col("_row_no") == F.greatest(F.col("_heads"), F.lit(1)), F.concat(sign, F.lit("|"), F.repeat(F.lit("---|"), F.col("_width")), F.lit("\n"))).otherwise("")
    granted = F.repeat(F.lit("\n"), (F.col("_t") - F.col("_was")).cast("int"))
    outer = F.repeat(F.lit("> "), F.col("depth") - 1)
    plain = F.when(what.isin(LINE, GAP), granted).when(what == TEXT, piece)
    marked = F.when((F.col("depth") > 0) & (plain != ""), F.concat(lead, F.regexp_replace(plain, F.lit(r"\n(?=[\s\S])"), F.concat(F.lit("\n"), sign)))).otherwise(plain)
    text = (
        F.when(what.isin(ROW, ROW_END, CELL), F.when(F.col("_width") == 0, "").when(what == ROW, F.concat(sign, F.lit("|"))).when(what == CELL, piece).otherwise(
            F.concat(F.repeat(F.lit("  |"), (F.col("_width") - F.col("_w")).cast("int")), F.lit("\n"), rule)))
        .when(F.col("_link") == F.col("scope"), F.when(what.isin(LINE, GAP), " ").otherwise(piece))
        .when(what == QUOTE_END, F.when((F.col("_was") == 0) & (F.col("_some") > 0), F.concat(F.lit("\n"), outer, F.lit("\n"))).otherwise(""))
        .when(what == LINK, lead)
        .when(what == QUOTED, "").otherwise(marked))
    return rows.withColumn("said", text)


def assemble(rows: DataFrame, strip_nav: bool = False, include_links: bool = True, include_images: bool = False,
             compact_links: bool = False, page_facts: list[Column] = ()) -> DataFrame:
    """(page_id, url, raw, refs and the `page_facts`) of node rows that are clustered on `page_id`.

    Beside NODE_COLUMNS the rows tell their `match` (number of the chosen part of the page they belong to), whether
    they open it (`_start`), and `_table`, the table whose row or cell they are. Rows without a match give no text; their
    `_info` is what the `page_facts`, aggregates by page, are taken from."""
    rows = staged(_filled(_linked(_visible(rows, strip_nav, include_images), include_links, compact_links)))
    rows = _settled(_events(rows))
    own, what = F.col("match").isNotNull(), F.col("what")
    below_link = F.col("_link").isNotNull() & (F.col("shut") >= 0)
    flat = rows.select(
        "page_id", *[F.when(below_link, F.col(name)).alias(out) for name, out in (("match", "_unit_match"), ("_link", "_unit"))],
        F.when(own, F.struct(*PLACE, F.when(what == LINK, "").otherwise(F.col("said")).alias("text"))).alias("_piece"),
        F.when(what == LINK, F.struct("_label", "_href", "_number", F.col("said").alias("lead"))).alias("_head"),
        *(["_info.*"] if page_facts else ["url"]))
    facts = list(page_facts) or [F.first("url").alias("url")]
    # A link and all below it are joined on their own, everything else of a page together.
    units = flat.groupBy("page_id", "_unit_match", "_unit").agg(
        F.array_sort(F.collect_list("_piece")).cast(f"array<{PIECE}>").alias("_pieces"), F.max("_head").alias("_head"), *facts)
    names = [c for c in units.columns if c not in ("page_id", "_unit_match", "_unit", "_pieces", "_head")]
    whole = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    units = units.withColumn("_said", F.when(F.col("_unit").isNotNull(), trim_ws(F.regexp_replace(F.coalesce("_head._label", whole), r"(?U)\s+", " "))))
    target = F.coalesce(F.concat(F.lit("["), F.col("_head._number").cast("string"), F.lit("]")), F.concat(F.lit("("), F.col("_head._href"), F.lit(")")))
    link = F.concat(F.col("_head.lead"), F.lit("["), F.col("_said"), F.lit("]"), target)
    joined = F.array(F.struct(*[F.col("_pieces")[0][c].alias(c) for c in PLACE], link.alias("text"))).cast(f"array<{PIECE}>")
    pieces = F.when(F.col("_unit").isNull(), F.col("_pieces")).otherwise(joined)
    ref = F.when(F.col("_head._number").isNotNull(), F.struct(F.col("_head._number").alias("i"), F.col("_said").alias("text"), F.col("_head._href").alias("href")))
    ordered = F.array_sort(F.flatten(F.collect_list(pieces)))
    return units.groupBy("page_id").agg(
        F.first(F.when(F.col("_unit").isNull(), F.struct(*names)), ignorenulls=True).alias("_facts"),
        F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("raw"),
        F.array_sort(F.collect_list(ref)).cast(REFS).alias("refs")).select("page_id", "_facts.*", "raw", "refs")


def whole_pages(nodes: DataFrame) -> DataFrame:
    """Node rows as `assemble` takes them, each page being one part."""
    return nodes.withColumns({"match": F.lit(0), "_start": F.col("kind") == "document", "_table": F.col("top_table")})


def _chosen(nodes: DataFrame, selector: str) -> DataFrame:
    """The rows of every match in document order, headings with their sections; a row in several matches comes once for
    each. A page without a match has one row without content. An invalid selector matches nothing."""
    try:
        rows = css_flag(nodes, selector, "_hit", keep_others=True)
    except ValueError:
        rows = nodes.withColumn("_hit", F.lit(False))
    rows = with_sections(rows)
    hit = F.struct("node_id", F.coalesce("_start.node_id", "node_id").alias("from"), F.coalesce("_stop_id", "end_id").alias("to"))
    fields = [c for c in (*NODE_COLUMNS, *CONTEXT) if c not in ("page_id", "url", "node_id", "attrs")]
    node = F.struct("node_id", *dict.fromkeys(fields), F.struct(*[F.col("attrs")[name].alias(name) for name in SHOWN_ATTRS]).alias("attrs"))
    pages = rows.groupBy("page_id").agg(
        F.first("url").alias("url"), F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("_hit"), hit))).alias("hits"))
    # Every part takes its own rows along and no others: the rows of the page beside each part would grow with their product.
    whole, deep = F.col("nodes"), ("deep_quote", "deep_row", "deep_list")
    cut = F.transform("hits", lambda h: F.struct(
        h["from"].alias("_from"), *[F.element_at(whole, h["from"] + 1)[name].alias(f"_top_{name}") for name in deep],
        F.slice(whole, h["from"] + 1, h["to"] - h["from"] + 1).alias("_own")))
    parts = pages.select("page_id", "url", F.posexplode_outer(cut).alias("match", "part")).select("page_id", "url", F.coalesce("match", F.lit(0)).alias("match"), "part.*")
    rows = parts.select(*[c for c in parts.columns if c != "_own"], F.inline_outer("_own"))

    def inner(name):
        return F.when(F.col(name) >= F.col("_from"), F.col(name))
    quoted = F.coalesce(F.col("near_quote") >= F.col("_from"), F.lit(False))
    depths = {"deep_quote": F.col("deep_quote") - F.col("_top_deep_quote"), "deep_row": F.col("deep_row") - F.col("_top_deep_row"),
              "deep_list": F.col("deep_list") - F.when(quoted, 0).otherwise(F.col("_top_deep_list"))}
    near = {name: inner(name) for name in CONTEXT if not name.startswith("deep_")}
    near["top_table"] = F.coalesce(inner("top_table"), inner("near_table"))
    return rows.withColumns({
        **near, **depths, "node_id": F.coalesce("node_id", F.lit(0)), "end_id": F.coalesce("end_id", F.lit(0)),
        "_start": F.col("node_id").isNull() | (F.col("node_id") == F.col("_from"))}).withColumn("_table", F.col("top_table"))


def html_markdown(pages: DataFrame, selector: str | None = None, strip_nav: bool = False,
                  include_links: bool = True, include_images: bool = False, compact_links: bool = False,
                  offset: int = 0, max_tokens: int | None = None, partitions: int | None = None) -> DataFrame:
    """(page_id, url, markdown, tokens_est, truncated, next_offset, refs).

    `refs` is the dense link list of `compact_links`. With a selector only its matches are rendered, from the same parse;
    a page without a match gives empty text.
    """
    if selector is None:
        nodes = html_nodes(pages, NODE_TAGS, kinds=("element", "text"), texts=CELLS, page_text=False, columns=NODE_COLUMNS, partitions=partitions)
        rows = whole_pages(clustered(nodes.filter("near_hidden IS NULL")))
    else:
        rows = _chosen(clustered(html_nodes(pages, texts=CELLS, page_text=False, columns=[*COLUMNS, *CONTEXT], partitions=partitions)), selector)
    rendered = assemble(rows, strip_nav, include_links, include_images, compact_links)
    page = truncate_tokens(normalize_ws(decode_entities("raw")), offset, max_tokens)
    return rendered.select("page_id", "url", page.alias("page"), "refs").select("page_id", "url", "page.*", "refs")


def chunks(rows: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """One row per chunk of the text column: (.., chunk_no, chunk). Joining chunks gives the text."""
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.posexplode(chunk_tokens(text, max_tokens)).alias("chunk_no", "chunk"))
