"""Whole page results: everything known about a page in one parse and one shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions.mime import BINARY_TOKENS, binary_placeholder, mime_base, route
from pagewright.functions.text import decode_entities, normalize_ws, truncate_tokens
from pagewright.operators.dom import clustered, html_nodes
from pagewright.operators.extract import (
    INFO_TAGS, MIN_SECTION_TOKENS, SELECTORS_NOTICE, candidate_entries, chosen_entries, entry_order,
    info_aggregates, info_columns, is_candidate, with_links, with_sections)
from pagewright.operators.feeds import feed_links, feed_markdown, feed_rows
from pagewright.operators.markdown import CELLS, CONTEXT, SHOWN_TAGS, assemble
from pagewright.session import written

#: Ranks of a sketch are off by a 10,000th of the rows at most; bounds of the median and of the 90 % quantile lie twice as far out.
ACCURACY = 10_000
BOUNDS = [(p, side) for p in (0.5, 0.9) for side in (-1, 1)]

COLUMNS_READ = ["page_id", "url", "node_id", "parent_id", "end_id", "sib", "kind", "tag", "attrs", "text", "text_from", "text_to",
                "parent_tag", "parent_end", "parent_to", "heading"]
LINKS = "array<struct<i:int,text:string,href:string>>"
SELECTORS = "array<struct<selector:string,tokens_est:bigint,label:string>>"
COLUMNS = ["page_id", "url", "title", "status", "markdown", "links", "lang", "description", "content_type",
           "tokens_est", "content_bytes", "truncated", "next_offset", "content_selectors"]


def page_results(pages: DataFrame, strip_nav: bool = False, include_links: bool = True, include_images: bool = False,
                 compact_links: bool = False, show_selectors_first: bool = True, offset: int = 0,
                 max_tokens: int | None = None, min_tokens: int = MIN_SECTION_TOKENS, partitions: int | None = None) -> DataFrame:
    """One row per HTML page (COLUMNS). Where content selectors exist and are asked for first, a
    notice takes the place of the Markdown and `tokens_est` is that of the whole page.

    One parse gives the rows of facts, links, areas and Markdown alike. Rows that contribute
    nothing are dropped at once; the rest is shuffled once, by `page_id`, and never joined.
    """
    nodes = html_nodes(pages, kinds=("element", "text"), texts=("title", "a", "h2", "h3", *CELLS), page_text=False,
                       columns=[*COLUMNS_READ, *CONTEXT], partitions=partitions).filter("near_hidden IS NULL")
    needed = (F.col("kind") == "document") | F.col("tag").isin(*INFO_TAGS, "a", "img")
    shown = (F.col("kind") != "element") | F.col("tag").isin(SHOWN_TAGS)
    if show_selectors_first:
        nodes = nodes.filter(needed | shown | is_candidate())
        rows = with_links(with_sections(clustered(nodes)))
    else:
        rows = with_links(clustered(nodes.filter(needed | shown)))
    # A row stands for its facts once, once more for each entry it contributes, and once in the Markdown.
    itself = F.lit(None).cast("struct<part:int,ord:int,selector:string,tokens_est:bigint,label:string>")
    entries = F.array_prepend(candidate_entries(min_tokens), itself) if show_selectors_first else F.array(itself)
    roles = F.transform(entries, lambda e: F.struct(F.lit(None).cast("int").alias("match"), e.alias("e")))
    in_text = F.struct(F.lit(0).alias("match"), itself.alias("e"))
    roles = F.when(needed | is_candidate(), roles).otherwise(F.slice(roles, 1, 0))
    rows = rows.withColumn("_role", F.explode(F.concat(roles, F.when(shown, F.array(in_text)).otherwise(F.slice(F.array(in_text), 1, 0)))))
    rows = rows.withColumns({"match": F.col("_role.match"), "_e": F.col("_role.e")})
    rows = chosen_entries(rows, "_e", min_tokens)
    own = F.col("_e").isNull() & F.col("match").isNull()
    facts = ["url", "text", "attrs", "node_id", "text_from", "text_to", "_e", "_chosen"]
    rows = rows.withColumn("_info", F.when(F.col("match").isNull(), F.struct(
        *facts, *[F.when(own, F.col(name)).alias(name) for name in ("tag", "kind")], F.when(own, F.col("_link")).alias("_link")))).drop("_link")

    link = F.when(F.col("_link").isNotNull(), F.struct("_link.i", "_link.text", "_link.href"))
    order = [c.alias(f"o{n}") for n, c in enumerate(entry_order("_e"))]
    chosen = F.when(F.col("_e").isNotNull() & F.col("_chosen"), F.struct(*order, F.struct("_e.selector", "_e.tokens_est", "_e.label").alias("s")))
    facts = [*info_aggregates(), F.array_sort(F.collect_list(link)).cast(LINKS).alias("_links"),
             F.transform(F.array_sort(F.collect_list(chosen)), lambda c: c["s"]).cast(SELECTORS).alias("_selectors")]
    rows = rows.withColumns({"_start": F.coalesce((F.col("match") == 0) & (F.col("kind") == "document"), F.lit(False)), "_table": F.col("top_table")})
    grouped = assemble(rows, strip_nav, include_links, include_images, compact_links, facts).withColumns(info_columns())
    if compact_links:
        grouped = grouped.withColumn("_links", F.col("refs"))
    hint = F.size("_selectors") > 0
    page = F.when(~hint, truncate_tokens(normalize_ws(decode_entities("raw")), offset, max_tokens))
    result = grouped.withColumn("_page", page).withColumns({
        "status": F.lit(200), "markdown": F.when(hint, F.lit(SELECTORS_NOTICE)).otherwise(F.col("_page.markdown")),
        "links": F.col("_links") if include_links else F.lit(None).cast(LINKS),
        "tokens_est": F.when(hint, F.col("page_tokens")).otherwise(F.col("_page.tokens_est")),
        "truncated": F.coalesce("_page.truncated", F.lit(False)), "next_offset": F.col("_page.next_offset"),
        "content_selectors": F.when(hint, F.col("_selectors"))})
    return result.select(*COLUMNS)


def response_results(responses: DataFrame, **options) -> DataFrame:
    """Results of `responses(page_id, url, status, content_type, html, body)`: binary bodies become
    placeholders, feeds feed Markdown, everything else goes through `page_results`.

    The kind is decided before any kernel runs, one filter per branch.
    """
    routed = responses.withColumn("_kind", route("content_type", "html"))
    base = mime_base("content_type", None)
    binary = routed.filter("_kind = 'binary'").select(
        "page_id", "url", F.lit(None).cast("string").alias("title"), "status",
        binary_placeholder("content_type", F.octet_length("body")).alias("markdown"), F.lit(None).cast(LINKS).alias("links"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("description"), base.alias("content_type"),
        F.lit(BINARY_TOKENS).cast("bigint").alias("tokens_est"), F.octet_length("body").cast("bigint").alias("content_bytes"),
        F.lit(False).alias("truncated"), F.lit(None).cast("bigint").alias("next_offset"),
        F.lit(None).cast(SELECTORS).alias("content_selectors"))
    feed = routed.filter("_kind = 'feed'")
    rows = feed_rows(feed)
    text = feed_markdown(rows, options.get("include_links", True), options.get("offset", 0), options.get("max_tokens"))
    links = feed_links(rows).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", "text", "href"))).cast(LINKS).alias("links"))
    known = feed.select("page_id", "url", "status", F.nullif(base, F.lit("")).alias("content_type"),
                        F.octet_length("html").cast("bigint").alias("content_bytes"))
    feeds = known.join(text, "page_id").join(links, "page_id", "left").withColumns({
        "lang": F.lit(None).cast("string"), "content_selectors": F.lit(None).cast(SELECTORS),
        "links": F.coalesce("links", F.array().cast(LINKS)) if options.get("include_links", True) else F.lit(None).cast(LINKS)})
    html = routed.filter("_kind = 'html'")
    pages = page_results(html, **options).drop("status").join(html.select("page_id", "status"), "page_id")
    return binary.unionByName(feeds.select(*COLUMNS)).unionByName(pages.select(*COLUMNS))


def page_report(results: DataFrame) -> DataFrame:
    """(page_id, report): the Markdown, a rule and the facts of the page as text."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"**{name}:** "), value.cast("string"), F.lit("\n")), F.lit(""))

    cut = F.when(F.col("truncated"), F.coalesce(
        F.concat(F.lit("true (use offset="), F.col("next_offset"), F.lit(" to continue)")), F.lit("true")))
    sections = F.array_join(F.transform("content_selectors", lambda s: F.concat(
        F.lit("- `"), s["selector"], F.lit("` — "), F.coalesce(F.concat(s["label"], F.lit(" (~"), s["tokens_est"], F.lit(" tokens)")),
                                                              F.concat(F.lit("~"), s["tokens_est"], F.lit(" tokens"))), F.lit("\n"))), "")
    report = F.concat(
        F.col("markdown"), F.lit("\n\n---\n"), line("Title", F.col("title")), line("URL", F.col("url")),
        line("Status", F.col("status")), line("Links", F.when(F.col("links").isNotNull(), F.size("links"))),
        line("Tokens (est)", F.col("tokens_est")), line("Truncated", cut),
        F.coalesce(F.concat(F.lit("\n**Content selectors:**\n"), sections), F.lit("")))
    return results.select("page_id", report.alias("report"))


def corpus_stats(results: DataFrame, by: Column, name: str = "grp") -> DataFrame:
    """Tokens, bytes, link counts and truncated pages by host, language or any other column.

    Aggregates combine before the shuffle, so one group may hold most of the corpus.
    """
    return results.groupBy(by.alias(name)).agg(
        F.count("*").alias("pages"), F.sum("tokens_est").alias("tokens"), F.max("tokens_est").alias("max_tokens"),
        F.sum("content_bytes").alias("bytes"), F.sum(F.size("links")).cast("bigint").alias("links"),
        F.count(F.when(F.col("truncated"), 1)).alias("truncated_pages"),
        F.percentile("tokens_est", 0.5).alias("median_tokens"))


def _bracketed(values: DataFrame, x: str, told, p: float) -> DataFrame:
    """One row (v): the quantile of a column, interpolated as `percentile` does, from the few values around its rank."""
    rank = p * max(told.n - 1, 0)
    low, high = math.floor(rank), math.ceil(rank)
    near = F.lit(True)
    if told.n > 10 * ACCURACY:  # the bounds are off by a rank of n / ACCURACY at most, and lie twice as far out
        near = F.col(x).between(*[told.at[BOUNDS.index((p, side))] for side in (-1, 1)])
    counted = values.filter(near & F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n"))
    below = F.lit(0) if told.n <= 10 * ACCURACY else F.lit(values.filter(F.col(x) < told.at[BOUNDS.index((p, -1))]).count())
    upto = F.sum("n").over(Window.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + below
    at = [F.min(F.when(F.col("_upto") > k, F.col(x))) for k in (low, high)]
    value = at[0] if low == high else (high - rank) * at[0] + (rank - low) * at[1]
    return counted.withColumn("_upto", upto).agg(value.alias("v"))


def section_savings(results: DataFrame) -> DataFrame:
    """(pages, median_saving, p90_saving): tokens of a page by those of its first content area, over all results
    that offer areas.

    The quantiles are exact. One number a page is kept; a sketch of bounded size says between which values a quantile
    lies, and only those few in 10,000 are put in order."""
    best = F.greatest(F.col("content_selectors")[0]["tokens_est"], F.lit(1))
    saving = written(results.filter(F.size("content_selectors") > 0).select((F.col("tokens_est") / best).alias("x")), "savings")
    told = saving.agg(F.count("x").alias("n"), F.percentile_approx("x", [p + 2 * side / ACCURACY for p, side in BOUNDS], ACCURACY).alias("at")).first()
    parts = [_bracketed(saving, "x", told, p).select(F.round("v", 6).alias(name)) for p, name in ((0.5, "median_saving"), (0.9, "p90_saving"))]
    return saving.agg(F.count("*").alias("pages")).crossJoin(parts[0]).crossJoin(parts[1])


def selectors_first(results: DataFrame) -> DataFrame:
    """Results with `notice`: was the page answered with its content selectors, or had it to be rendered?"""
    return results.withColumn("notice", F.col("content_selectors").isNotNull())
