"""Inputs of the registered queries: the given tables, and pages, feeds and logs derived from them by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.operators.dom import shared_out

SITE = "https://site.example"
COOKIE_NAMES = ["session_id", "theme", "cart", "auth_token", "lang"]
COOKIE_DOMAINS = ["a.example", "b.a.example", "c.example"]
PAGES_PER_TASK = 4096


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Bodies dealt over as many partitions as the session's `pagewright.partitions` says; as they are if it says nothing.

    It is a shuffle of bodies, for files whose row groups are fewer than the cores."""
    partitions = rows.sparkSession.conf.get("pagewright.partitions", None)
    return rows if partitions is None else rows.repartition(int(partitions))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt out by a key before bodies are made of them, some thousand to a task.

    A file of narrow rows has few row groups, and one of them would be parsed by one task however many pages it makes."""
    partitions = rows.sparkSession.conf.get("pagewright.partitions", None)
    return rows.repartition(int(partitions) if partitions else max(
        rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PAGES_PER_TASK)), key)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages")
    return shared_out(dealt(rows), rows.count())


def escape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(out, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _with_next(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the address of the page that follows by id."""
    following = table(spark, sf, "pages").select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return pages(spark, sf).join(following, "page_id", "left")


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with one more anchor at the end, to the next page."""
    anchor = F.concat(F.lit('<a href="'), escape(F.col("next_url")), F.lit('">Next page</a>'))
    return _with_next(spark, sf).select("page_id", "url", F.concat("html", F.coalesce(anchor, F.lit(""))).alias("html"))


def redirecting_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that send the reader to the next page, except every fourth."""
    tag = F.concat(F.lit('<head><meta http-equiv="refresh" content="0; url='), escape(F.col("next_url")), F.lit('">'))
    moved = F.replace(F.col("html"), F.lit("<head>"), tag)
    stays = (F.col("page_id") % 4 == 0) | F.col("next_url").isNull()
    return _with_next(spark, sf).select("page_id", "url", F.when(stays, F.col("html")).otherwise(moved).alias("html"))


def document_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """One RSS body per document: the channel is its source, every non-blank line an item."""
    legal = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    lines = F.filter(F.split(legal, r"\n"), lambda s: F.trim(s) != "")
    items = F.transform(lines, lambda s, n: F.concat(
        F.lit("<item><title>"), escape(F.trim(s)), F.lit("</title><link>/d/"), F.col("doc_id").cast("string"), F.lit("/"),
        n.cast("string"), F.lit("</link><category>"), F.col("lang"), F.lit("</category><description>"),
        escape(F.concat(F.lit("<p>"), escape(F.trim(s)), F.lit("</p>"))), F.lit("</description></item>")))
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), F.col("source"),
                    F.lit("</title><description>"), F.col("lang"), F.lit("</description>"), F.array_join(items, ""),
                    F.lit("</channel></rss>"))
    return dealt(documents(spark, sf)).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit(f"{SITE}/feed/"), F.col("source")).alias("url"), body.alias("html"))


def document_articles(spark: SparkSession, sf: str) -> DataFrame:
    """One page per document: every non-blank line a paragraph under a heading with an id."""
    lines = F.filter(F.split("text", r"\n"), lambda s: F.trim(s) != "")
    parts = F.transform(lines, lambda s, n: F.concat(
        F.lit('<h2 id="s'), n.cast("string"), F.lit('">Part '), n.cast("string"), F.lit("</h2><p>"), escape(s), F.lit("</p>")))
    rows = documents(spark, sf)
    articles = dealt(rows).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit(f"{SITE}/doc/"), F.col("doc_id")).alias("url"),
        F.concat(F.lit("<body>"), F.array_join(parts, "")).alias("html"))
    return shared_out(articles, rows.count())


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")


def customer_forms(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer with an account form."""
    name, segment = escape(F.col("c_name")), escape(F.col("c_mktsegment"))
    key = F.col("c_custkey").cast("string")
    checked = F.when(F.col("c_nationkey") % 2 == 0, " checked").otherwise("")
    html = F.concat(
        F.lit('<form id="acct" method="post" action="/save/'), key, F.lit('"><input name="name" value="'), name,
        F.lit('"><input type="checkbox" name="news" value="yes"'), checked,
        F.lit('><input type="submit" name="go" value="Go"><select name="segment"><option>NONE<option value="'), segment,
        F.lit('" selected>'), segment, F.lit('</select><textarea name="note">nation '), F.col("c_nationkey").cast("string"),
        F.lit('</textarea><input name="empty"></form>'))
    return _customers(spark, sf).select(
        F.col("c_custkey").alias("page_id"), F.concat(F.lit(f"{SITE}/c/"), key).alias("url"), html.alias("html"))


def nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer with a two-column table, its header in a `thead`."""
    html = F.concat(
        F.lit("<table><thead><tr><th>field<th>value</thead><tr><td>name<td>"), escape(F.col("c_name")),
        F.lit("<tr><td>segment<td> <b>"), escape(F.col("c_mktsegment")), F.lit("</b> <tr><td>nation</table>"))
    return _customers(spark, sf).select(
        F.col("c_custkey").alias("page_id"), F.concat(F.lit(f"{SITE}/t/"), F.col("c_custkey")).alias("url"), html.alias("html"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", _k())


def history_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "purchase"), "visit").when(kind == "click", "back").when(kind == "signup", "forward").otherwise("failed")
    url = F.when(op == "visit", F.concat(F.lit(f"{SITE}/"), kind, F.lit("/"), F.col("k").cast("string")))
    return events(spark, sf).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", op.alias("op"), url.alias("url"),
        F.concat(F.lit("Page "), F.col("k").cast("string")).alias("title"), F.lit(200).alias("status"))


def storage_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("purchase", "view"), "set").when(kind == "click", "get").when(kind == "signup", "delete").when(
        F.col("k") < 20, "clear").otherwise("get")
    return events(spark, sf).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), op.alias("op"),
        F.concat(F.lit("https://o"), (F.col("k") % 2).cast("string"), F.lit(".example")).alias("origin"),
        F.when(op != "clear", F.concat(F.lit("key"), (F.col("k") % 7).cast("string"))).alias("key"),
        F.when(op == "set", F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"))


def _pick(values: list[str], at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[at]


def cookie_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = events(spark, sf).filter(kind.isin("purchase", "signup", "error"))
    op = F.when(kind == "signup", "delete").otherwise("set")
    is_set = op == "set"
    return rows.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", op.alias("op"),
        _pick(COOKIE_NAMES, F.col("k") % 5).alias("name"),
        F.when(is_set, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"),
        _pick(COOKIE_DOMAINS, F.col("k") % 3).alias("domain"),
        F.when(is_set, F.when(F.col("k") % 4 == 1, "/shop").otherwise("/")).alias("path"),
        F.when(is_set, F.col("k") % 6 == 0).alias("secure"), F.lit(False).alias("http_only"),
        F.when(is_set & (F.col("k") % 4 == 0), F.col("k").cast("bigint") * 3600).alias("max_age"))


def cookie_requests(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.when(F.col("k") % 2 == 0, "https://").otherwise("http://"), _pick(COOKIE_DOMAINS, F.col("k") % 3),
                   F.when(F.col("k") % 4 < 2, "/shop/cart").otherwise("/shopping"))
    return events(spark, sf).filter(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", url.alias("url"))


def command_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A command log per user. Some lines are blank, some broken, some lack a field or a target."""
    kind, k = F.col("event_type"), F.col("k")
    seq = F.col("event_id") * 7919 % 10007
    head = [F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit(1).alias("v"), seq.alias("seq")]

    def command(action: Column, *fields: Column) -> Column:
        return F.to_json(F.struct(*head, action.alias("action"), *fields))

    line = (
        F.when((kind == "error") & (k < 10), "   ")
        .when(kind == "error", F.concat(F.lit('{"id":"e'), F.col("event_id").cast("string"), F.lit('","seq":')))
        .when(kind == "view", command(F.lit("fetch"), F.concat(F.lit("/p/"), k.cast("string")).alias("url")))
        .when(kind == "click", command(F.when(k == 7, "quit").when(k == 8, "jump").otherwise("links")))
        .when(kind == "signup", command(F.lit("storage_set"), F.concat(F.lit("key"), k.cast("string")).alias("key"),
                                        F.when(k % 10 != 0, F.col("value").cast("string")).alias("value")))
        .otherwise(command(F.lit("fetch"))))
    return events(spark, sf).select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))


def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with seven wrapped result links at the end, the third an advertisement."""
    hits = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda n: F.concat(
        F.lit('<a href="/l/?'), F.when(n == 2, "ad_domain=x&amp;").otherwise(""), F.lit("uddg="),
        F.url_encode(F.concat(F.col("url"), F.lit("+"), n.cast("string"))), F.lit('&amp;rut=1">Hit '), n.cast("string"), F.lit("</a>")))
    return pages(spark, sf).select("page_id", "url", F.concat("html", F.array_join(hits, "")).alias("html"))
