"""Session state against plain replays of the log, with segments small enough that they matter."""
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pagewright.operators import cookies, history, running, storage

SEGMENT = 7


def log(seed, n, ops, sessions=3, hot=0.6):
    rng = random.Random(seed)
    for seq in range(n):
        yield ("hot" if rng.random() < hot else f"s{rng.randrange(sessions)}"), seq, rng.choice(ops), rng


def test_running_values(spark):
    rows = [(s, q, rng.choice([None, rng.randrange(50)])) for s, q, _, rng in log(1, 200, ["x"])]
    frame = spark.createDataFrame(rows, "k string, seq long, v int")
    for inclusive in (False, True):
        found = {r.seq: (r.last, r.top, r.total) for r in running.running(frame, ["k"], "seq", {
            "last": ("last", F.col("v")), "top": ("max", F.col("v")), "total": ("sum", F.col("v"))}, inclusive, SEGMENT).collect()}
        for key, seq, value in rows:
            past = [v for k, q, v in rows if k == key and v is not None and (q < seq or inclusive and q == seq)]
            assert found[seq] == (past[-1] if past else None, max(past, default=None), sum(past))


@pytest.mark.parametrize("ops", [["visit", "back", "forward"], ["visit"] + ["back"] * 4 + ["forward"] * 3, ["visit"] * 5 + ["back", "forward", "other"], ["back", "forward"]])
def test_history(spark, ops):
    rows = [(s, q, op, f"u{rng.randrange(9)}", f"T{q}", 200) for s, q, op, rng in log(len(ops), 300, ops)]
    events = spark.createDataFrame(rows, "session string, seq long, op string, url string, title string, status int")
    stacks, expected = {}, {}
    for session, seq, op, url, _, _ in rows:
        stack, cursor = stacks.get(session, ([], -1))
        code = None
        if op == "visit":
            stack, cursor = stack[:cursor + 1] + [url], cursor + 1
        elif op == "back":
            code, cursor = (None, cursor - 1) if cursor > 0 else ("NO_HISTORY", cursor)
        elif op == "forward":
            code, cursor = (None, cursor + 1) if cursor < len(stack) - 1 else ("NO_HISTORY", cursor)
        stacks[session] = (stack, cursor)
        expected[seq] = (cursor, len(stack), code, stack[cursor] if stack else None)
    positions = history.history_positions(events, SEGMENT).cache()
    found = {r.seq: (r.cursor, r.length, r.code, r.current_url) for r in history.current_page(positions, SEGMENT).collect()}
    assert found == expected
    entries = {}
    for r in history.history(positions).orderBy("session", "index").collect():
        entries.setdefault(r.session, []).append((r.url, r.current))
    assert entries == {s: [(u, n == c) for n, u in enumerate(stack)] for s, (stack, c) in stacks.items() if stack}


def test_history_search(spark):
    entries = spark.createDataFrame(
        [("s", n, f"https://e.com/{n}", t, 200, n == 3) for n, t in enumerate(["Rust", "python", None, "RUSTY", "Go"])],
        "session string, index long, url string, title string, status int, current boolean")
    found = history.history_search(entries, "rust", 1).collect()
    assert [(r["index"], r["count"], r.total) for r in found] == [(3, 1, 5)]
    assert [r["index"] for r in history.history_search(entries, None, 10).orderBy("rank").collect()] == [4, 3, 2, 1, 0]


def test_storage(spark):
    rows = [(s, q, op, f"o{rng.randrange(2)}", f"k{rng.randrange(3)}", f"v{q}") for s, q, op, rng in log(5, 400, ["set", "set", "get", "delete", "clear", "list"])]
    events = spark.createDataFrame(rows, "session string, seq long, op string, origin string, key string, value string")
    state, gets, deletes, clears = {}, {}, {}, {}
    for session, seq, op, origin, key, value in rows:
        items = state.setdefault((session, origin), {})
        if op == "set":
            items[key] = value
        elif op == "get":
            gets[seq] = items.get(key)
        elif op == "delete":
            deletes[seq] = items.pop(key, None) is not None
        elif op == "clear":
            clears[seq] = len(items)
            items.clear()
    assert {(r.session, r.origin, r.key): r.value for r in storage.storage_state(events).collect()} == {
        (*scope, k): v for scope, items in state.items() for k, v in items.items()}
    assert {r.seq: r.value for r in storage.storage_get(events, SEGMENT).collect()} == gets
    assert {r.seq: r.deleted for r in storage.storage_deletes(events, SEGMENT).collect()} == deletes
    assert {r.seq: r.cleared for r in storage.storage_clears(events, SEGMENT).collect()} == clears


def test_storage_origin_and_merge(spark):
    rows = spark.createDataFrame([(None, None), (None, "https://a.com/x"), ("https://o", None), (None, "data:x")], "origin string, current_url string")
    assert [(r.origin, r.storage_code) for r in storage.with_origin(rows).collect()] == [
        (None, "NO_PAGE"), ("https://a.com", None), ("https://o", None), (None, "SESSION_ERROR")]
    saved = spark.createDataFrame([("s", "o", "k", "old"), ("s", "o", "z", "kept")], "session string, origin string, key string, value string")
    merged = storage.merge_snapshot([("o", "k", "preset"), ("p", "n", "new")], saved)
    assert {(r.origin, r.key): r.value for r in merged.collect()} == {("o", "k"): "preset", ("o", "z"): "kept", ("p", "n"): "new"}
    every = spark.createDataFrame([("s",), ("fresh",)], "session string")
    merged = storage.merge_snapshot([("o", "k", "preset")], saved, every)
    assert {(r.session, r.origin, r.key): r.value for r in merged.collect()} == {
        ("s", "o", "k"): "preset", ("s", "o", "z"): "kept", ("fresh", "o", "k"): "preset"}


def test_cookies(spark):
    names, domains, paths = ["sid", "theme"], ["a.com", "b.a.com"], ["/", "/shop", "/shop/"]
    events, requests = [], []
    for session, seq, op, rng in log(9, 300, ["set", "set", "delete", "ask", "ask"], sessions=2):
        if op == "ask":
            url = rng.choice(["http://", "https://"]) + rng.choice(["a.com", "b.a.com", "x.b.a.com", "c.com"]) + rng.choice(["/", "/shop", "/shop/x", "/shopping"])
            requests.append((session, seq, seq, url))
        else:
            events.append((session, seq, seq, op, rng.choice(names), f"v{seq}", rng.choice(domains), rng.choice(paths),
                           rng.random() < 0.3, False, rng.choice([None, 40])))
    jar_of, headers, deleted = {}, {}, {}
    for row in sorted(events + requests, key=lambda r: r[1]):
        jar = jar_of.setdefault(row[0], {})
        if len(row) == 4:
            scheme, _, rest = row[3].partition("://")
            host, _, path = rest.partition("/")
            path = "/" + path
            sent = [(-len(p), n, d, v) for (d, p, n), (v, secure, until) in jar.items()
                    if (host == d or host.endswith("." + d)) and (path == p or path.startswith(p if p.endswith("/") else p + "/"))
                    and (scheme == "https" or not secure) and until > row[1]]
            headers[row[1]] = "; ".join(f"{n}={v}" for _, n, _, v in sorted(sent)) or None
        elif row[3] == "set":
            jar[(row[6], row[7], row[4])] = (row[5], row[8], row[1] + row[10] if row[10] else float("inf"))
        else:
            gone = [k for k in jar if (k[0], k[2]) == (row[6], row[4])]
            deleted[row[1]] = any([jar.pop(k)[2] > row[1] for k in gone])
    stamp = F.timestamp_seconds(F.col("at")).alias("ts")
    log_frame = spark.createDataFrame(events, "session string, seq long, at long, op string, name string, value string, domain string, path string, secure boolean, http_only boolean, max_age long").select("*", stamp)
    asked = spark.createDataFrame(requests, "session string, seq long, at long, url string").select("session", "seq", "url", stamp)
    assert {r.seq: r.cookie for r in cookies.cookie_header(asked, log_frame, SEGMENT).collect()} == headers
    assert {r.seq: r.deleted for r in cookies.deleted_flags(log_frame, SEGMENT).collect()} == deleted
    jar = cookies.cookie_jar(log_frame).cache()
    assert {(r.session, r.domain, r.path, r.name): r.value for r in jar.collect()} == {
        (s, *k): v[0] for s, items in jar_of.items() for k, v in items.items()}
    back = cookies.import_jar(cookies.export_jar(jar))
    assert back.exceptAll(jar.select(*back.columns)).count() == 0 and back.count() == jar.count()


def test_cookie_lines(spark):
    lines = ["id=a=b; Domain=.E.com; Path=/p; Max-Age=60; Secure; HttpOnly", "x=1; max-age=soon; path=rel", "novalue", " n = v "]
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(lines)], "n int, v string").orderBy("n")
    found = [r[0] and tuple(r[0]) for r in frame.select(cookies.parse_set_cookie("v")).collect()]
    assert found == [("id", "a=b", "e.com", "/p", True, True, 60), ("x", "1", None, None, False, False, None), None,
                     ("n", "v", None, None, False, False, None)]


def test_preload_and_list(spark):
    sessions = spark.createDataFrame([("s",), ("s",), ("t",)], "session string")
    first = cookies.preload([{"name": "pre", "value": "1", "domain": "x.a.com"}], sessions)
    jar = cookies.cookie_jar(first)
    assert jar.count() == 2
    now = F.timestamp_seconds(F.lit(0))
    assert cookies.list_cookies(jar, now, "*.a.com").count() == 2 and cookies.list_cookies(jar, now, "a.com").count() == 0
    assert {r.session: r.cookies_count for r in cookies.cookie_counts(jar, now).collect()} == {"s": 1, "t": 1}


@pytest.mark.parametrize("spread", [1, 1_000_003, "uneven"])
def test_segments_stay_bounded_however_sparse_the_positions(spark, spread):
    at = F.pow(F.col("id") % 1000, 3).cast("long") * 1_000_000_000 + F.col("id") if spread == "uneven" else F.col("id") * spread
    log = spark.range(4000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), at.alias("at"),
                                   (F.col("id") % 13).alias("v"))
    rows = running.segmented(log, "at", 200)
    sizes = [r["count"] for r in rows.groupBy("k", "_seg").count().collect()]
    assert max(sizes) <= 260 and rows.select("_seg").distinct().count() <= 20
    totals = {(r.k, r.at): (r.s, r.m) for r in running.running(rows, ["k"], "at", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).collect()}
    seen = {}
    for r in sorted(log.collect(), key=lambda r: r["at"]):
        s, m = seen.get(r.k, (0, None))
        assert totals[(r.k, r["at"])] == (s, m)
        seen[r.k] = (s + r.v, r.v if m is None else max(m, r.v))


def test_one_scan_serves_all_running_values(spark):
    """The log is read and parsed once; what reads it again reads the kept table."""
    for name, most in (("storage_asof", 1), ("storage_clears", 1), ("seq_validate", 1), ("result_envelopes", 1), ("cookie_header", 2)):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") + plan.count("from_json") <= most, name


def test_only_paths_that_fit_are_probed(spark, monkeypatch):
    probes = []

    def watched(log, *given, **named):
        probes.extend((r.seq, r.path) for r in log.filter("op = 'probe'").collect())
        return running.running(log, *given, **named)

    monkeypatch.setattr(cookies, "running", watched)
    sets = spark.createDataFrame([(1, k, "set", f"n{k}", "v", "a.example", path, False, False, None) for k, path in enumerate(("/shop", "/", "/shopping/x"))],
                                 "session long, seq long, op string, name string, value string, domain string, path string, secure boolean, http_only boolean, max_age long")
    sets = sets.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    asked = spark.createDataFrame([(1, 10, "http://a.example/shopping"), (1, 11, "http://a.example/shop/cart"), (2, 12, "http://a.example/shop")],
                                  "session long, seq long, url string").withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    found = {r.seq: r.cookie for r in cookies.cookie_header(asked, sets).collect()}
    assert found == {10: "n1=v", 11: "n0=v; n1=v", 12: None}
    assert sorted(p for p in probes if p[1]) == [(10, "/"), (11, "/"), (11, "/shop")]
