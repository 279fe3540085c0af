"""RSS 2.0, RSS 1.0/RDF and Atom: a pull-parse kernel to flat rows, everything else as columns."""

from __future__ import annotations

import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagewright.functions.text import clean_description, collapse_ws, truncate_tokens
from pagewright.functions.urls import display_href
from pagewright.operators.dom import in_batches

# Element names that fill each field.
ITEM_FIELDS = {
    "title": "title", "link": "link", "description": "description", "summary": "description",
    "content": "description", "pubdate": "date", "date": "date", "published": "date", "updated": "date",
    "category": "category", "subject": "category",
}
CHANNEL_FIELDS = {"title": "title", "link": "link", "description": "description", "subtitle": "description",
                  "updated": "updated", "date": "updated"}
# A bare ampersand outside CDATA would end the parse; it is read as the character itself.
_BARE_AMP = re.compile(r"<!\[CDATA\[.*?\]\]>|&(?!#?\w+;)", re.S)
FEED_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("idx", T.IntegerType()),  # null on the channel row
    *[T.StructField(name, T.StringType()) for name in ("title", "link", "description", "date", "category")],
])
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("idx", pa.int32())] + [
    (name, pa.string()) for name in ("title", "link", "description", "date", "category")])


class _FeedReader:
    def __init__(self):
        self.channel, self.items, self.item = {}, [], None
        self.stack, self.text = [], []

    def start(self, name, attrs):
        name = name.rsplit(":", 1)[-1].lower()
        if name == "link" and ("feed" in self.stack or "entry" in self.stack):
            if attrs.get("rel", "alternate") == "alternate" and "href" in attrs:
                self._fill("link", attrs["href"])
        elif name == "category" and self.item is not None and "term" in attrs:
            self.item.setdefault("category", attrs["term"])
        if name in ("item", "entry"):
            self.item = {}
        self.stack.append(name)
        self.text = []

    def end(self, name):
        name = name.rsplit(":", 1)[-1].lower()
        text, self.text = "".join(self.text).strip(), []
        names = ITEM_FIELDS if self.item is not None else CHANNEL_FIELDS
        if text and name in names:
            self._fill(names[name], text)
        if name in ("item", "entry") and self.item is not None:
            if "title" in self.item or "link" in self.item:
                self.items.append(self.item)
            self.item = None
        self.stack.pop()

    def _fill(self, field, value):
        if self.item is not None:
            self.item.setdefault(field, value)
        elif "channel" in self.stack or "feed" in self.stack:
            self.channel.setdefault(field, value)

    def data(self, text):
        self.text.append(text)


def parse_feed(source: str):
    """(channel, items) of a feed body; broken XML keeps what was finished before the break."""
    reader = _FeedReader()
    parser = expat.ParserCreate("utf-8")  # the text is decoded already, whatever its prolog says
    parser.buffer_text = True
    parser.UseForeignDTD(True)  # undeclared entities are skipped instead of fatal
    parser.StartElementHandler, parser.EndElementHandler = reader.start, reader.end
    parser.CharacterDataHandler = reader.data
    try:
        source = _BARE_AMP.sub(lambda m: m[0] if m[0] != "&" else "&amp;", source.lstrip())
        parser.Parse(source.encode("utf-8", "replace"), True)
    except expat.ExpatError:
        pass
    return reader.channel, reader.items


def _batch(rows):
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), _ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def feed_rows(pages: DataFrame) -> DataFrame:
    """Channel row (null `idx`, date holds `updated`) and item rows of `pages(page_id, url, html)`."""
    def kernel(batches):
        def rows():
            for batch in batches:
                for page_id, url, source in zip(*(column.to_pylist() for column in batch.columns)):
                    channel, items = parse_feed(source or "")
                    yield (page_id, url, None, channel.get("title"), channel.get("link"),
                           channel.get("description"), channel.get("updated"), None)
                    for idx, item in enumerate(items):
                        yield (page_id, url, idx, *(item.get(n) for n in (
                            "title", "link", "description", "date", "category")))

        return in_batches(rows(), 5, _batch)

    return pages.select("page_id", "url", "html").mapInArrow(kernel, FEED_SCHEMA)


def feeds(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("idx").isNull()).select(
        "page_id", "url", "title", "description", "link", F.col("date").alias("updated"))


def feed_items(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("idx").isNotNull())


def _filled(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def item_title() -> Column:
    return F.coalesce(_filled("title"), F.lit("(untitled)"))


def item_href() -> Column:
    return F.coalesce(display_href("url", F.trim(F.col("link"))), F.lit(""))


def feed_links(rows: DataFrame) -> DataFrame:
    """(page_id, i, text, href): the address of each item that has one; `i` is the item index."""
    return feed_items(rows).select("page_id", F.col("idx").alias("i"), item_title().alias("text"),
                                   item_href().alias("href")).filter("href <> ''")


def feed_markdown(rows: DataFrame, include_links: bool = True, offset: int = 0,
                  max_tokens: int | None = None) -> DataFrame:
    """(page_id, title, description, markdown, tokens_est, truncated, next_offset) per feed.

    Each row becomes its own text first; the only aggregation joins the ordered pieces of one body.
    """
    def line(text: Column) -> Column:
        return F.when(text.isNotNull(), F.concat(text, F.lit("\n"))).otherwise("")

    # Values used more than once are columns of a first step, so each is computed once per row.
    channel_row = F.col("idx").isNull()
    values = rows.select(
        "page_id", "idx", "title", "description", F.trim("date").alias("date"), _filled("date").alias("when"),
        _filled("category").alias("category"), item_title().alias("name"), item_href().alias("href"),
        F.nullif(F.when(channel_row, F.rtrim(collapse_ws("description"))).otherwise(clean_description("description")), F.lit("")).alias("body"))
    head = F.concat(
        line(F.concat(F.lit("# "), F.col("title"))),
        line(F.when(~F.col("body").eqNullSafe(F.col("title")), F.concat(F.lit("*"), F.col("body"), F.lit("*")))),
        line(F.concat(F.lit("*Updated: "), F.col("date"), F.lit("*"))))
    head = F.concat(head, F.when(F.coalesce("title", "body", "date").isNotNull(), "\n").otherwise(""))
    linked = F.when((F.col("href") != "") & F.lit(include_links), F.concat(
        F.lit("## ["), F.col("name"), F.lit("]("), F.col("href"), F.lit(")"))).otherwise(F.concat(F.lit("## "), F.col("name")))
    meta = F.nullif(F.concat_ws(" · ", "when", "category"), F.lit(""))
    item = F.concat(line(linked), line(meta), line(F.concat(F.lit("\n"), F.col("body"))), F.lit("\n"))
    pieces = values.select("page_id", F.coalesce("idx", F.lit(-1)).alias("ord"), "title", "description",
                           F.when(channel_row, head).otherwise(item).alias("piece"))
    channel = F.col("ord") == -1
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda r: r["piece"]), "")
    page = truncate_tokens(F.regexp_replace("_text", r"(?U)\s+\z", ""), offset, max_tokens)
    return (pieces.groupBy("page_id").agg(
        F.max(F.when(channel, F.col("title"))).alias("title"),
        F.max(F.when(channel, F.col("description"))).alias("description"), text.alias("_text"))
        .select("page_id", "title", "description", page.alias("p")).select(
            "page_id", "title", "description", "p.*"))
