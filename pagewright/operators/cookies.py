"""Cookies: parsing, the jar as of a time, and the header each request would carry.

`events(session, seq, ts, op, name, value, domain, path, secure, http_only, max_age)`, op `set` or
`delete`. A cookie is known by (session, domain, path, name); a delete removes all paths of
(name, domain).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import as_col
from pagewright.functions.urls import domain_matches, host, parse_path
from pagewright.operators.running import SEGMENT_ROWS, running
from pagewright.session import checkpointed

NAMED = ["session", "domain", "name"]
COOKIE = ["session", "domain", "path", "name"]


def parse_set_cookie(text) -> Column:
    """struct(name, value, domain, path, secure, http_only, max_age) of a Set-Cookie line.

    Null without a `name=`. Attribute names ignore case; a bad Max-Age counts as none.
    """
    text = as_col(text)
    parts = F.transform(F.split(text, ";"), lambda p: F.trim(p))
    pair = parts[0]
    at = F.instr(pair, "=")
    attrs = F.slice(parts, 2, F.size(parts))

    def attr(name: str) -> Column:
        hits = F.filter(attrs, lambda p: F.lower(p).startswith(name + "="))
        return F.trim(F.substring(F.element_at(hits, -1), F.lit(len(name) + 2), F.length(text)))

    def flag(name: str) -> Column:
        return F.exists(attrs, lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))) == name)

    domain = F.lower(F.regexp_replace(F.when(F.exists(attrs, lambda p: F.lower(p).startswith("domain=")),
                                             attr("domain")), r"^\.", ""))
    path = F.when(F.exists(attrs, lambda p: F.lower(p).startswith("path=/")), attr("path"))
    age = F.when(F.exists(attrs, lambda p: F.lower(p).startswith("max-age=")), attr("max-age").try_cast("bigint"))
    return F.when(at > 1, F.struct(
        F.trim(F.left(pair, at - 1)).alias("name"), F.trim(F.substring(pair, at + 1, F.length(text))).alias("value"),
        domain.alias("domain"), path.alias("path"), flag("secure").alias("secure"),
        flag("httponly").alias("http_only"), age.alias("max_age")))


def preload(rules: list[dict], sessions: DataFrame) -> DataFrame:
    """Configured cookies as `set` events before the first event of every session (seq -1)."""
    cookies = F.array(*[F.struct(
        F.lit("set").alias("op"), F.lit(r["name"]).alias("name"), F.lit(r["value"]).alias("value"),
        F.lit(r["domain"]).alias("domain"), F.lit(r.get("path", "/")).alias("path"),
        F.lit(r.get("secure", False)).alias("secure"), F.lit(r.get("http_only", False)).alias("http_only"),
        F.lit(None).cast("bigint").alias("max_age")) for r in rules])
    return sessions.select("session").distinct().select(
        "session", F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.inline(cookies))


def expires_at(ts="ts", max_age="max_age") -> Column:
    return F.timestamp_add("SECOND", F.col(max_age), F.col(ts))


def cookie_jar(events: DataFrame) -> DataFrame:
    """Cookies left at the end of the log, expired ones included:
    (session, domain, path, name, value, secure, http_only, expires)."""
    deletes = events.filter("op = 'delete'").groupBy(*NAMED).agg(F.max("seq").alias("_deleted"))
    kept = F.struct("seq", "value", "secure", "http_only", expires_at().alias("expires"))
    sets = events.filter("op = 'set'").groupBy(*COOKIE).agg(F.max_by(kept, "seq").alias("c"))
    return sets.join(deletes, NAMED, "left").filter(F.col("c.seq") > F.coalesce("_deleted", F.lit(-2))).select(
        *COOKIE, "c.value", "c.secure", "c.http_only", "c.expires")


def list_cookies(jar: DataFrame, as_of: Column, domain: str | None = None) -> DataFrame:
    """Unexpired cookies, optionally of domains matching a rule pattern."""
    fresh = jar.filter(F.col("expires").isNull() | (F.col("expires") > as_of))
    return fresh if domain is None else fresh.filter(domain_matches(F.lit(domain), F.col("domain")))


def cookie_counts(jar: DataFrame, as_of: Column) -> DataFrame:
    return list_cookies(jar, as_of).groupBy("session").agg(F.count("*").alias("cookies_count"))


def deleted_flags(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(session, seq, name, domain, deleted): did the delete remove an unexpired cookie?

    A delete ends all paths, so only sets after the previous delete matter, and of those the one
    that lives longest; a later set of the same path replaces the earlier, which is why paths are
    looked at separately first.
    """
    cuts = running(events, NAMED, "seq", {"_since": ("last", F.when(F.col("op") == "delete", F.col("seq")))},
                   segment_rows=segment_rows).withColumn("_since", F.coalesce("_since", F.lit(-2)))
    kept = F.struct(F.coalesce(expires_at(), F.lit("9999-12-31").cast("timestamp")).alias("e"))
    per_path = cuts.filter("op = 'set'").groupBy(*NAMED, "_since", "path").agg(F.max_by(kept, "seq").alias("k"))
    best = per_path.groupBy(*NAMED, "_since").agg(F.max("k.e").alias("_until"))
    return cuts.filter("op = 'delete'").join(best, [*NAMED, "_since"], "left").select(
        "session", "seq", "name", "domain", F.coalesce(F.col("_until") > F.col("ts"), F.lit(False)).alias("deleted"))


def host_suffixes(name: Column) -> Column:
    """A host and its parent domains: the cookie domains that can apply to it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, k, F.size(labels)), "."))


def cookie_header(requests: DataFrame, events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(session, seq, url, cookie) for `requests(session, seq, ts, url)`: the header as of each one.

    A request meets the different cookies ever set for its domains (an equi-join), and a running
    value gives the state of each at that moment, so no request is compared with old versions.
    Order in the header: longest path first, then name.
    """
    shape = "struct<value:string,secure:boolean,expires:timestamp,seq:bigint>"
    kept = F.struct("value", "secure", expires_at().alias("expires"), "seq")
    events = checkpointed(events.select(*COOKIE, "seq", "ts", "op", F.when(F.col("op") == "set", kept).cast(shape).alias("c")))
    known = events.filter("op = 'set'").groupBy(*NAMED).agg(F.collect_set("path").alias("paths"))
    paths = known.groupBy("session", "domain").agg(F.collect_list(F.struct("name", "paths")).alias("names"))
    none = F.lit(None).cast("string")
    asked = requests.withColumns({"_host": host("url"), "_target": parse_path("url")}).select(
        "session", "seq", "ts", "url", "_target", F.explode(host_suffixes(F.col("_host"))).alias("domain"))

    def fits(path: Column) -> Column:
        target = F.col("_target")
        return (target == path) | (target.startswith(path) & (path.endswith("/") | (F.substring(target, F.length(path) + 1, F.lit(1)) == "/")))

    # Paths that do not fit are no probes. A request without any cookie keeps one row, so that it is found again in the end.
    names = F.flatten(F.transform("names", lambda n: F.transform(F.filter(n["paths"], fits), lambda p: F.struct(n["name"].alias("name"), p.alias("path")))))
    probes = asked.join(paths, ["session", "domain"], "left").withColumn("k", F.explode_outer(names)).select(
        "session", "domain", "k.path", "k.name", "seq", "ts", "url", F.lit("probe").alias("op"), F.lit(None).cast(shape).alias("c"))
    sets = events.filter("op = 'set'").select(*COOKIE, "seq", "ts", none.alias("url"), "op", "c")
    # a delete names no path: it is repeated for the paths known under its name
    deletes = events.filter("op = 'delete'").select(*NAMED, "seq", "ts", "op", "c").join(known, NAMED).select(
        "session", "domain", F.explode("paths").alias("path"), "name", "seq", "ts", none.alias("url"), "op", "c")
    log = probes.unionByName(sets).unionByName(deletes)
    state = F.when(F.col("op") != "probe", F.struct((F.col("op") == "set").alias("live"), F.col("c")))
    seen = running(log, COOKIE, "seq", {"_s": ("last", state)}, segment_rows=segment_rows).filter("op = 'probe'")
    sent = (F.col("_s.live") & (~F.coalesce("_s.c.secure", F.lit(False)) | F.col("url").startswith("https:"))
            & (F.col("_s.c.expires").isNull() | (F.col("_s.c.expires") > F.col("ts"))))
    pair = F.when(sent, F.struct((-F.length("path")).alias("o"), "name", "domain", F.col("_s.c.value").alias("value")))
    text = F.array_join(F.transform("_pairs", lambda p: F.concat(p["name"], F.lit("="), p["value"])), "; ")
    return seen.groupBy("session", "seq", "url").agg(F.array_sort(F.collect_list(pair)).alias("_pairs")).select(
        "session", "seq", "url", F.when(F.size("_pairs") > 0, text).alias("cookie"))


def export_jar(jar: DataFrame) -> DataFrame:
    """(session, cookies_json), one document per session."""
    record = F.struct("name", "value", "domain", "path", "secure", "http_only", F.col("expires").cast("string").alias("expires"))
    return jar.groupBy("session").agg(F.to_json(F.array_sort(F.collect_list(record))).alias("cookies_json"))


def import_jar(saved: DataFrame) -> DataFrame:
    """Jar rows of (session, cookies_json). They replace the session's jar, preloaded cookies included."""
    shape = "array<struct<name:string,value:string,domain:string,path:string,secure:boolean,http_only:boolean,expires:timestamp>>"
    return saved.select("session", F.inline(F.from_json("cookies_json", shape))).select(
        *COOKIE, "value", "secure", "http_only", "expires")
