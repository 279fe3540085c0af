"""Pages as answers: fetching from a stored corpus, following links and redirects, link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagewright.functions.mime import is_retryable, route
from pagewright.functions.urls import absolute_href, normalize_url, resolve_url
from pagewright.operators.extract import client_redirect, redirect_nodes
from pagewright.session import checkpointed

REDIRECT_HOPS = 5


def url_key(url):
    """Join key of an address: its standard spelling without the fragment."""
    return F.regexp_replace(normalize_url(url), "#.*$", "")


def page_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id), one page per address (the smallest id answers for duplicates)."""
    return pages.select(url_key("url").alias("key"), "page_id").filter("key IS NOT NULL").groupBy("key").agg(
        F.min("page_id").alias("page_id"))


def fetch_from_corpus(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """`requests(request_id, url)` answered from stored pages: page_id, or an error code.

    A bad address is INVALID_URL, a miss HTTP_ERROR (retryable). Page bodies stay out of the join;
    an address asked for very often is split by adaptive skew handling, as its answer is one row.
    """
    keyed = requests.withColumn("key", url_key("url"))
    answered = keyed.join(page_keys(pages), "key", "left")
    code = F.when(F.col("key").isNull(), "INVALID_URL").when(F.col("page_id").isNull(), "HTTP_ERROR")
    return answered.withColumn("code", code).withColumn(
        "retryable", F.when(code.isNotNull(), is_retryable(code))).select(*requests.columns, "page_id", "code", "retryable")


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst, pos): every link whose address is a page of the corpus."""
    edges = links.select(F.col("page_id").alias("src"), "pos", url_key(absolute_href("url", "raw_href")).alias("key"))
    return edges.join(page_keys(pages).withColumnRenamed("page_id", "dst"), "key").select("src", "dst", "pos")


def dangling_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose address is no page of the corpus."""
    edges = links.withColumn("key", url_key(absolute_href("url", "raw_href")))
    return edges.join(page_keys(pages).select("key"), "key", "left_anti").select(*links.columns)


def link_degrees(graph: DataFrame) -> DataFrame:
    """(page_id, out_degree, in_degree) over pages with any edge. One aggregation over both ends,
    combined before the shuffle, so a page that everything links to is no hot spot."""
    ends = graph.select(F.inline(F.array(
        F.struct(F.col("src").alias("page_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("page_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("page_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def asked_pages(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """The pages that `asked(page_id)` names, chosen before any of them is parsed."""
    return pages.join(asked.select("page_id").distinct(), "page_id", "left_semi")


def follow_by_index(events: DataFrame, links: DataFrame) -> DataFrame:
    """`events(event_id, page_id, index)` with the absolute `target` of the link at that dense
    position, or LINK_NOT_FOUND."""
    at = links.select("page_id", F.col("pos").alias("index"), resolve_url("url", "href").alias("target"), F.lit(True).alias("_hit"))
    joined = events.join(at, ["page_id", "index"], "left")
    return _followed(joined, events.columns)


def follow_by_text(events: DataFrame, links: DataFrame) -> DataFrame:
    """`events(event_id, page_id, needle)`: the first link of the page whose text contains the
    needle, letter case ignored.

    The links of a page travel as one array (bounded by the page), so an event meets one row and no
    pairs of needles and links are produced, however many events ask about one page.
    """
    link = F.struct("pos", F.lower("text").alias("t"), "url", "href")
    per_page = links.groupBy("page_id").agg(F.array_sort(F.collect_list(link)).alias("_links"))
    needle = F.lower("needle")
    first = F.element_at(F.filter("_links", lambda k: k["t"].contains(needle)), 1)
    joined = events.join(per_page, "page_id", "left").withColumn(
        "_l", F.when(F.exists("_links", lambda k: k["t"].contains(needle)), first))
    return _followed(joined.withColumn("target", resolve_url("_l.url", "_l.href")).withColumn(
        "_hit", F.when(F.col("_l").isNotNull(), True)), events.columns)


def _followed(joined: DataFrame, columns: list[str]) -> DataFrame:
    code = F.when(F.col("_hit").isNull(), "LINK_NOT_FOUND").when(F.col("target").isNull(), "INVALID_URL")
    return joined.withColumn("code", code).select(*columns, "target", "code")


def links_of_current(current: DataFrame, links: DataFrame) -> DataFrame:
    """`current(session, page_id)` with the links of the page and their count."""
    counted = links.select("page_id", "pos", "text", "href", F.count("*").over(Window.partitionBy("page_id")).alias("count"))
    return current.join(counted, "page_id")


def redirect_moves(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, url, target) of `declared(page_id, url, target)`: the move of the page that answers
    for each address; none to itself."""
    moves = declared.filter(F.col("target") != F.col("url"))
    return moves.join(page_keys(pages), "page_id").select("key", "url", "target")


def follow_redirects(starts: DataFrame, moves: DataFrame, hops: int = REDIRECT_HOPS) -> DataFrame:
    """`starts(page_id, url)` with `final_url`, `hops` and `cut` after at most `hops` moves; `cut` tells that the
    page reached moves on.

    Chains are first closed over `moves` alone (pages that do move are few; the table is kept, as
    every hop reads it), then every start is joined once. A chain ends where there is no move, or at a move to its own address.
    """
    moves = checkpointed(moves)
    step = moves.select(F.col("key").alias("_from"), F.col("target").alias("_to"))
    chains = moves.select("key", F.col("target").alias("final_url"), F.lit(1).alias("hops"), F.lit(True).alias("_on"))
    for _ in range(hops - 1):
        # a chain at rest gets a key of its own: it matches nothing and does not pile up on null
        at = F.when(F.col("_on"), url_key("final_url"))
        stepped = chains.withColumn("_from", F.coalesce(at, F.concat(F.lit("at rest "), "key"))).join(step, "_from", "left")
        go = F.coalesce(F.col("_to") != F.col("final_url"), F.lit(False))
        chains = stepped.select("key", F.when(go, F.col("_to")).otherwise(F.col("final_url")).alias("final_url"),
                                (F.col("hops") + go.cast("int")).alias("hops"), go.alias("_on"))
    at = F.when(F.col("_on"), url_key("final_url"))
    chains = chains.withColumn("_from", F.coalesce(at, F.concat(F.lit("at rest "), "key"))).join(step, "_from", "left").withColumn(
        "cut", F.coalesce(F.col("_to") != F.col("final_url"), F.lit(False)))
    ends = chains.select("key", F.col("final_url").alias("_final"), F.col("hops").alias("_hops"), F.col("cut").alias("_cut"))
    return starts.withColumn("key", url_key("url")).join(ends, "key", "left").select(
        *starts.columns, F.coalesce("_final", "url").alias("final_url"), F.coalesce("_hops", F.lit(0)).alias("hops"),
        F.coalesce("_cut", F.lit(False)).alias("cut"))


def replaced_pages(pages: DataFrame, hops: int = REDIRECT_HOPS) -> DataFrame:
    """`pages(page_id, url, html, ...)` with address, body and all other columns of the page that its redirects lead to,
    and `hops`.

    Pages whose `content_type`, where there is that column, is binary do not move on, whatever their body looks like. Where an
    address answers nothing, the last page that answered stays. Bodies are joined once, with the ends of the chains
    and not with every hop."""
    keys = page_keys(pages)
    asked = pages
    if "content_type" in pages.columns:
        asked = pages.filter(route("content_type", "html") == "html")
    answered = client_redirect(redirect_nodes(asked)).withColumn("_to", url_key("target")).join(keys.select(F.col("key").alias("_to")), "_to", "left_semi")
    moves = redirect_moves(answered.select("page_id", "url", "target"), pages)
    ends = follow_redirects(pages.select("page_id", "url"), moves, hops).select("page_id", "hops", url_key("final_url").alias("key"))
    reached = ends.join(keys.withColumnRenamed("page_id", "_end"), "key", "left").select("page_id", "hops", F.when(F.col("hops") > 0, F.coalesce("_end", "page_id")).otherwise(F.col("page_id")).alias("_end"))
    return reached.join(pages.withColumnRenamed("page_id", "_end"), "_end").select("page_id", *[c for c in pages.columns if c != "page_id"], "hops")


def search_hits(links: DataFrame, n: int = 5) -> DataFrame:
    """(page_id, rank, title, url): the first `n` results of each search page.

    Result links carry their target in a `uddg` parameter; advertisements are left out.
    """
    wrapped = F.regexp_extract("href", r"(?:^|[?&])uddg=([^?&]*)", 1)
    # `+` is an ordinary character here, while form decoding would read it as a space
    target = F.coalesce(F.try_url_decode(F.replace(wrapped, F.lit("+"), F.lit("%2B"))), wrapped)
    ad = F.col("href").contains("ad_domain") | F.col("href").contains("ad_provider")
    order = Window.partitionBy("page_id").orderBy("i")
    return (links.filter((F.col("text") != "") & F.col("href").rlike("(^|[?&])uddg=") & ~ad)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .select("page_id", "rank", F.col("text").alias("title"), target.alias("url")))
