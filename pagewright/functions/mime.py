"""Content types, charsets, body routing, errors and request options as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from pagewright.functions import as_col

# Content types treated as text, and as feeds.
TEXT_TYPES = ["application/xhtml+xml", "application/xml", "application/json", "application/javascript"]
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/rdf+xml",
              "application/feed+xml", "application/xml", "text/xml"]
# Markers of a feed root element.
FEED_ROOTS = ["<rss", "<feed", "<rdf:RDF", "<RDF"]
BINARY_TOKENS = 10
# Error codes that a caller may retry.
RETRYABLE = ["TIMEOUT", "HTTP_ERROR"]


def mime_base(ct, default: str | None = "text/html") -> Column:
    """The media type before any parameter. `default` stands in for a missing header."""
    base = F.trim(F.split_part(as_col(ct), F.lit(";"), F.lit(1)))
    return base if default is None else F.coalesce(base, F.lit(default))


def is_text_mime(m) -> Column:
    m = F.lower(as_col(m))
    return m.startswith("text/") | m.isin(TEXT_TYPES) | m.endswith("+xml") | m.endswith("+json")


def is_feed_mime(m) -> Column:
    m = F.lower(as_col(m))
    return m.isin(FEED_TYPES) | m.endswith("+xml")


def charset_of(ct) -> Column:
    """Lower-case label after `charset=`, null if there is none."""
    label = F.regexp_extract(F.lower(as_col(ct)), r"charset=\s*\"*([^;\"]*?)\"*\s*(?:;|$)", 1)
    return F.nullif(F.trim(label), F.lit(""))


@pandas_udf(T.StringType())
def _decode_other(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Charsets the JVM-side decoder lacks; an unknown label falls back to lossy UTF-8."""
    import codecs

    # Web label aliases (fixed values): these labels all mean windows-1252.
    aliases = dict.fromkeys(["iso-8859-1", "latin1", "ascii", "us-ascii", "l1"], "windows-1252")

    def codec(label: str) -> str:
        try:
            return codecs.lookup(aliases.get(label, label)).name
        except LookupError:
            return "utf-8"

    for bodies, labels in batches:
        yield pd.Series([None if body is None else bytes(body).decode(codec(label or ""), "replace")
                         for body, label in zip(bodies, labels)])


def decode_bodies(df: DataFrame, body: str, charset: str, out: str) -> DataFrame:
    """Add `out`, the decoded text; an unknown label or invalid bytes decode lossily. Rows are split by charset so UTF-8 rows never reach Python."""
    plain = F.col(charset).isNull() | F.col(charset).isin("utf-8", "utf8")
    utf8 = df.filter(plain).withColumn(out, F.make_valid_utf8(F.col(body).cast("string")))
    other = df.filter(~plain).withColumn(out, _decode_other(F.col(body), F.col(charset)))
    return utf8.unionByName(other)


def looks_like_feed(body) -> Column:
    """Whether the root element is one of a feed, whatever prolog, comments and document type stand before it."""
    space, prolog = r"(?U:\s++)", r"<\?(?:(?!\?>)[\s\S])*+\?>"
    comment, kind = r"<!--(?:(?!-->)[\s\S])*+-->", r"<![A-Za-z](?:[^>\[]|\[[^\]]*+\])*+>"
    before = rf"\A\x{{FEFF}}?(?:{space}|{prolog}|{comment}|{kind})*+"
    return as_col(body).rlike(rf"{before}(?:{'|'.join(FEED_ROOTS)})(?=[\s/>])")


def route(content_type, body) -> Column:
    """`binary`, `feed` or `html` for one response."""
    content_type = as_col(content_type)
    base = mime_base(content_type, "")
    feed = (is_feed_mime(base) | (base == "")) & looks_like_feed(body)
    return F.when(~is_text_mime(mime_base(content_type)), "binary").when(feed, "feed").otherwise("html")


def binary_placeholder(content_type, size, path=None) -> Column:
    """Stand-in text for a body that is not text; with `path`, the note of a saved download."""
    mime = mime_base(content_type, "application/octet-stream")
    size = as_col(size).cast("bigint")
    plain = F.format_string("[Binary content: %s, %d bytes]", mime, size)
    if path is None:
        return plain
    return F.when(as_col(path).isNull(), plain).otherwise(
        F.format_string("[Downloaded %s, %d bytes to %s]", mime, size, as_col(path)))


def classify_error(kind) -> Column:
    kind = as_col(kind)
    return F.when(kind == "timeout", "TIMEOUT").when(
        kind.isin("connect", "redirect", "status", "request"), "HTTP_ERROR").when(
        kind == "bad_url", "INVALID_URL").otherwise("SESSION_ERROR")


def is_retryable(code) -> Column:
    return as_col(code).isin(RETRYABLE)


def merge_options(max_tokens, session_max_tokens) -> Column:
    """Only the token limit falls back to the session default."""
    return F.coalesce(as_col(max_tokens), as_col(session_max_tokens))


def fetch_mode(url, index, text) -> Column:
    """Which of the three ways to name a page applies; null where none was given."""
    return F.when(as_col(url).isNotNull(), "url").when(as_col(index).isNotNull(), "index").when(
        as_col(text).isNotNull(), "text")


def fetch_mode_code(url, index, text) -> Column:
    return F.when(fetch_mode(url, index, text).isNull(), "INVALID_COMMAND")
