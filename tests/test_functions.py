import pytest
from pyspark.sql import functions as F

from pagewright.functions import mime, sqlnames, text, urls
from plain_markdown import shown_address

BASE = "https://Example.com:443/a/b/c?x=1#f"
HREFS = [
    "https://o.com/x", "//cdn.io/y?z", "/root", "rel", "../up", "./same/", "?q=2", "#top", "", "mailto:a@b",
    "http://EXAMPLE.com:80", "/für?ä=1'", "/a/../../b/.", "javascript:void(0)", "https:rel2", "/a b", "http://[::1]:8080/x",
    "HTTPS://u:p@Host.com/%2e/x", "?", "#", "a\\b", "/x^y`{}|[]\\", "  /sp \n", "a;b=1?c#d", "..", "../..", "/a//b",
    "https://ex.com:8443/x", "/a#b#c", '/q?"<>`{}|^', '/#"<>`{}|^', "http://h", "a:b", "https://example.com/own?q#f",
    "https://example.com", "https://Example.com/UP", "/.hidden", "/a/.b/../c", "//", "/%2e%2e/x", "https://example.com./x",
]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()


def rows(spark, values, column, kind="string"):
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in frame.orderBy("n").select(column).collect()]


@pytest.mark.parametrize("href, expected", [
    ("https://other.com/p", "https://other.com/p"), ("//cdn.com/p", "https://cdn.com/p"), ("/root", "https://example.com/root"),
    ("rel", "https://example.com/a/b/rel"), ("../up", "https://example.com/a/up"), ("?q", "https://example.com/a/b/c?q"),
    ("#f", "https://example.com/a/b/c?x=1#f"), ("", "https://example.com/a/b/c?x=1"), ("/a b", "https://example.com/a%20b")])
def test_resolve(spark, href, expected):
    assert one(spark, urls.resolve_url(F.lit(BASE), F.lit(href)))[0] == expected


@pytest.mark.parametrize("base", [BASE, "http://h.example/x/y.html", "not a url", "https://example.com"])
def test_display_href_agrees_with_plain_python(spark, base):
    frame = spark.createDataFrame([(base, h) for h in HREFS], "b string, h string")
    for row in frame.select("h", urls.display_href("b", "h").alias("d")).collect():
        assert row.d == shown_address(base, row.h), row.h


@pytest.mark.parametrize("base", ["https://example.com/a/b?q", "http://x-y.example/"])
def test_clean_addresses_take_the_same_way(spark, base):
    """The short way for clean addresses gives what the full rules give."""
    frame = spark.createDataFrame([(base, h) for h in HREFS], "b string, h string")
    full_abs = urls._resolved(F.col("b"), F.col("h"), lambda _, p, o: F.coalesce(urls._text(p), o))
    full_norm = urls.let(urls.let(urls._split(urls._trimmed(F.col("h"))), urls._normalized), urls._text)
    picked = frame.select("h", urls.resolve_url("b", "h").alias("r"), full_abs.alias("fr"), urls.normalize_url("h").alias("n"), full_norm.alias("fn"))
    for row in picked.collect():
        assert row.r == row.fr, row.h
        assert row.n == row.fn, row.h


def test_origin_and_hosts(spark):
    found = rows(spark, ["HTTPS://A.com:443/x", "http://a.com:8080", "data:x", "https://u:p@b.com/"], urls.origin("v"))
    assert found == ["https://a.com", "http://a.com:8080", None, "https://b.com"]
    assert rows(spark, ["a.b.c"], urls.domain_keys("v"), "string") == [["a.b.c", "*.b.c", "*.c"]]


@pytest.mark.parametrize("pattern, name, expected", [
    ("api.github.com", "API.github.com", True), ("*.github.com", "raw.github.com", True), ("*.example.com", "example.com", False),
    ("*.example.com", "a.b.example.com", True), ("*.example.com", "badexample.com", False), ("example.com", "a.example.com", False)])
def test_domain_matches(spark, pattern, name, expected):
    assert one(spark, urls.domain_matches(F.lit(pattern), F.lit(name)))[0] is expected


def test_search_and_refresh(spark):
    assert one(spark, urls.search_url(F.lit("https://s/?q={}&r={}"), F.lit("a b~*é+")))[0] == "https://s/?q=a+b%7E*%C3%A9%2B&r={}"
    found = rows(spark, ["5;url=https://e.com/", "0; URL='/x'", "3", "0;url=", '0;url="q"'], urls.meta_refresh_target("v"))
    assert found == ["https://e.com/", "/x", None, None, "q"]


def test_entities(spark):
    given = ["&amp;", "&#x41;", "&#233;", "a&#0;b", "a&#8238;b", "&amp;lt;", "&unknown; & x", "&#xD800;", "&nbsp;|&apos;", "&#99999999999;"]
    assert rows(spark, given, text.decode_entities("v")) == [
        "&", "A", "é", "ab", "ab", "&lt;", "&unknown; & x", "&#xD800;", " |'", "&#99999999999;"]


def test_whitespace(spark):
    assert rows(spark, ["  a \n\t b  ", " x y", " "], text.collapse_ws("v")) == ["a b ", "x y", ""]
    assert rows(spark, ["\n\na  \n\n\n\n b\t\n", "x", " \n "], text.normalize_ws("v")) == ["a\n\n b", "x", ""]
    assert rows(spark, ["a<b>c</b> <un", "1 > 0"], text.strip_tags("v")) == ["a c  ", "1 > 0"]
    assert rows(spark, ["<p>x &lt;b&gt;</p>  y "], text.clean_description("v")) == ["x <b> y"]
    assert rows(spark, ["a‮b\u0007c\n"], text.strip_dangerous("v")) == ["abc\n"]


def truncated(md, offset, limit):
    """The rule in plain words: bytes, newline borders, no split characters."""
    data = md.encode()

    def floor(b, pos):
        pos = min(pos, len(b))
        while 0 < pos < len(b) and 0x80 <= b[pos] <= 0xBF:
            pos -= 1
        return pos

    begin = floor(data, offset * 4)
    if begin >= len(data):
        return "", 0, False, None
    if begin:
        begin = data.find(b"\n", begin) + 1 or len(data)
    rest = data[begin:]
    end = len(rest) if limit is None else floor(rest, limit * 4)
    if end >= len(rest):
        return rest.decode(), len(rest) // 4, False, None
    end = rest[:end].rfind(b"\n") + 1 or end
    return rest[:end].decode(), end // 4, True, offset + end // 4


@pytest.mark.parametrize("offset, limit", [(0, 10), (0, 1), (7, 33), (13, None), (99999, 5), (3, 2)])
def test_truncate_against_brute_force(spark, offset, limit):
    docs = ["line é one\nline two\n\nthree ééé three\nend", "ääääääääää" * 9, "\n" * 30, "x", "a\nb\nc\n" * 40]
    found = rows(spark, docs, text.truncate_tokens("v", offset, limit))
    assert [tuple(r) for r in found] == [truncated(d, offset, limit) for d in docs]


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_chunks_are_whole_and_bounded(spark, limit):
    docs = ["", "a", "é" * 101 + "\nshort\n\n\nlast line without end", "word " * 200, "\n\n\n"]
    for doc, chunks in zip(docs, rows(spark, docs, text.chunk_tokens("v", limit))):
        assert "".join(chunks) == doc
        assert all(len(c.encode()) <= limit * 4 for c in chunks)


def test_mime(spark):
    given = ["text/html; charset=\"UTF-8\"", "application/rss+xml", "image/png", None, "application/ld+json"]
    assert rows(spark, given, mime.charset_of("v"))[0] == "utf-8"
    assert rows(spark, given, mime.is_text_mime(mime.mime_base("v"))) == [True, True, False, True, True]
    body = F.lit("<?xml version='1.0'?>\n<feed>")
    assert rows(spark, given, mime.route("v", body)) == ["html", "feed", "binary", "feed", "html"]
    assert rows(spark, ["timeout", "connect", "bad_url", "x"], mime.classify_error("v")) == ["TIMEOUT", "HTTP_ERROR", "INVALID_URL", "SESSION_ERROR"]
    assert one(spark, mime.fetch_mode(F.lit(None), F.lit(3), F.lit("t")), mime.fetch_mode_code(*[F.lit(None)] * 3))[:] == ("index", "INVALID_COMMAND")


def test_decode_bodies(spark):
    frame = spark.createDataFrame([
        (1, b"h\xc3\xa9", "utf-8"), (2, b"h\xe9 \x80", "iso-8859-1"), (3, b"h\xff", None), (4, b"\x82\xa0", "shift_jis"), (5, b"ok\xff", "nonsense")],
        "n int, body binary, charset string")
    found = {r.n: r.t for r in mime.decode_bodies(frame, "body", "charset", "t").collect()}
    assert found == {1: "hé", 2: "hé €", 3: "h�", 4: "あ", 5: "ok�"}


def test_base64(spark):
    assert one(spark, text.b64_encode(F.lit("é" * 100)), text.b64_decode(F.lit("aMOp")), text.b64_decode(F.lit("!!")))[1:] == ("hé", None)


def test_sql_names(spark):
    sqlnames.register(spark)
    row = spark.sql("SELECT pw_collapse_ws('  a  b '), pw_origin('https://a.com:443/x'), pw_domain_matches('*.b.c', 'a.b.c'), pw_mime_base(NULL)").first()
    assert row[:] == ("a b ", "https://a.com", True, "text/html")
    tags = spark.sql("SELECT tag FROM pw_html_nodes('<p>x<b>y') WHERE kind = 'element' ORDER BY node_id").collect()
    assert [t.tag for t in tags] == ["html", "head", "body", "p", "b"]


ADDRESSES = ["https://u:p@h.example/x", "http://Example.com:80/a?b#c", "HTTPS://EX.com:8443", "  https://a.b\\c", "ftp://f.example:21/", "mailto:a@b", "", None,
             "http://[::1]:8080/x", "https://h.example:443?q=@x", "ws://w.example:81/", "/path", "http://u@h.example:080/"]
TEXTS = ["a &amp;amp; b", "&lt;i&gt; &quot;x&quot; &apos; &nbsp;|", "&#65;&#x42;&#x+43; &#0; &#8238;x", "&#xD800; &#1114112; &#99999999999; &bogus; & x", "<p>  a\u3000b <b>&lt;c</b> ", "<open", None, ""]


def test_sql_names_agree_with_the_columns(spark):
    sqlnames.register(spark)
    frame = spark.createDataFrame([(a,) for a in ADDRESSES], "v string")
    for row in frame.select("v", urls.origin("v").alias("o"), F.expr("pw_origin(v)").alias("so"), urls.host("v").alias("h"), F.expr("pw_host(v)").alias("sh")).collect():
        assert (row.o, row.h or None) == (row.so, row.sh), row.v
    frame = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    pairs = {"pw_decode_entities": text.decode_entities, "pw_clean": text.clean_description, "pw_collapse_ws": text.collapse_ws, "pw_strip_tags": text.strip_tags,
             "pw_normalize_ws": text.normalize_ws, "pw_tokens": text.estimate_tokens}
    for name, column in pairs.items():
        for row in frame.select("v", column("v").alias("c"), F.expr(f"{name}(v)").alias("s")).collect():
            assert row.c == row.s, (name, row.v)
