import json
import os
import time

import pandas as pd
from pyspark.sql import functions as F

from pagewright.operators import commands, cookies, history, navigation, storage
from pagewright.session import checkpoint_dir
from pagewright.sources import logs, pages as page_io
from pagewright.streaming import flows, state

SEGMENT = 3


def cmd(seq, action="info", **more):
    return json.dumps({"id": f"c{seq}", "v": 1, "seq": seq, "action": action, **more})


def frame_of(spark, *lines):
    return spark.createDataFrame([("log", n, line) for n, line in enumerate(lines, 1)], "log string, line_no long, line string")


def test_lines_of_wrong_types(spark):
    good = '{"v":1,"id":"a","seq":1,"action":"info"}'
    lines = [good, good + " trailing", good.replace('"a"', "5"), good.replace('"v":1', '"v":-1'), '{"v":1,"id":"b","seq":2,"action":"fetch","url":7}',
             good[:-1] + ',"url":null,"more":{"id":5}}', good + good, good.replace('"seq":1', '"seq":"1"')]
    rows = spark.createDataFrame([("l", n, line) for n, line in enumerate(lines)], "log string, line_no long, line string")
    found = {r.line_no: r.bad for r in commands.parse_commands(rows).collect()}
    assert [found[n] for n in range(7)] == [False, True, True, True, True, False, True]


def test_order_and_quit(spark):
    lines = [cmd(5), "", cmd(3), "not json", cmd(6), cmd(6, "back"), "{}", cmd(7, "quit"), cmd(8)]
    rows = commands.check_commands(frame_of(spark, *lines), SEGMENT).orderBy("line_no").collect()
    assert [(r.line_no, r.accepted, r.reply_seq, r.code) for r in rows] == [
        (1, True, 5, None), (3, False, 3, "INVALID_COMMAND"), (4, False, 6, "INVALID_COMMAND"), (5, True, 6, None), (6, False, 6, "INVALID_COMMAND"),
        (7, False, 7, "INVALID_COMMAND"), (8, True, 7, None)]
    first = commands.check_commands(frame_of(spark, "bad", cmd(1)), SEGMENT).orderBy("line_no").first()
    assert first.reply_seq == 0


def test_required_fields(spark):
    lines = [
        (cmd(1, "fetch", url="u"), None), (cmd(2, "fetch"), "fetch"), (cmd(3, "fetch", index=0), None), (cmd(4, "dom_query"), "dom_query"),
        (cmd(5, "dom_query", script="x"), None), (cmd(6, "fill", selector="s"), "fill"), (cmd(7, "fill", selector="s", value="v"), None),
        (cmd(8, "fill", fields=[{"selector": "s", "value": "v"}]), None), (cmd(9, "fill", fields=[{"selector": "s"}]), "line"), (cmd(10, "jump"), "line"),
        (cmd(11, "submit"), "line"), (cmd(12, "storage_get"), "line"), (cmd(13, "storage_get", key="k", extra=1), None), (cmd(14, "fetch", url="u", method="POST"), None),
        (cmd(15, "fetch", url="u", method="GRAB"), "line"), (cmd(16, "config", step_delay=0.5), None), (cmd(17, "config", step_delay=[2, 1]), "line"),
        (cmd(18, "config", step_delay=[1, 2]), None), (cmd(19, "links", v="x"), "line"), (json.dumps({"id": "x", "v": 1, "action": "info"}), "line")]
    rows = commands.check_commands(frame_of(spark, *[line for line, _ in lines])).orderBy("line_no").collect()
    for row, (line, word) in zip(rows, lines):
        assert (row.error or "").startswith(word or "") and (row.code is None) == (word is None), line


def test_envelopes_and_results(spark):
    checked = commands.check_commands(frame_of(spark, cmd(1, "config"), cmd(2), "bad", cmd(3, "quit"))).cache()
    out = commands.envelope(checked, commands.control_data()).orderBy("line_no").collect()
    assert [json.loads(r.json) for r in out] == [
        {"id": "c1", "ok": True, "seq": 1, "status": "configured"}, {"id": "c2", "ok": True, "seq": 2},
        {"id": "", "ok": False, "seq": 3, "error": "line 3: invalid command", "code": "INVALID_COMMAND", "retryable": False},
        {"id": "c3", "ok": True, "seq": 3, "status": "quit"}]
    answers = spark.createDataFrame([("log", 1, "c1", 1, True, None), ("log", 2, "c2", 2, False, "TIMEOUT"), ("log", 3, "c2", 2, True, None)],
                                    "log string, line_no long, id string, seq long, ok boolean, code string")
    asked = checked.filter("NOT bad")
    assert [r.id for r in commands.unanswered(asked, answers).collect()] == ["c3"]
    assert {r.id: r.ok for r in commands.match_results(asked, answers).collect()} == {"c1": True, "c2": True}
    assert {r.id: r.ok for r in commands.dedup_retries(answers).collect()} == {"c1": True, "c2": False}
    assert [tuple(r) for r in commands.error_counts(answers).collect()] == [("TIMEOUT", 1)]
    assert {r.action: (r.n, r.errors) for r in commands.action_counts(asked).collect()} == {"config": (1, 0), "info": (1, 0), "quit": (1, 0)}


def test_read_commands_numbers_lines_across_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 10)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = logs.read_commands(spark, str(tmp_path))
        assert rows.count() == 3010
        assert rows.filter(F.col("line") != F.concat(F.element_at(F.split("log", "/"), -1), F.lit(" "), F.col("line_no"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sinks_and_sources(spark, tmp_path, pages_of):
    out = commands.envelope(commands.check_commands(frame_of(spark, *[cmd(n) for n in range(1, 21)])).coalesce(1))
    page_io.write_results(out, str(tmp_path / "results"), per_file=6)
    files = [f for f in os.listdir(tmp_path / "results") if f.startswith("part-")]
    assert len(files) >= 4 and spark.read.json(str(tmp_path / "results")).count() == 20
    bodies = spark.createDataFrame([(1, "u", "image/png", b"1234"), (2, "u", "text/html", b"x"), (3, "u", None, b"y")], "page_id long, url string, content_type string, body binary")
    notes = page_io.write_binaries(bodies, str(tmp_path / "bin"))
    assert notes.first().markdown == f"[Downloaded image/png, 4 bytes to {tmp_path}/bin]" and spark.read.parquet(str(tmp_path / "bin")).count() == 1
    pages_of("<p>x").write.parquet(str(tmp_path / "pages"))
    page_io.create_views(page=page_io.read_pages(spark, str(tmp_path / "pages")))
    assert spark.sql("SELECT count(*) FROM page").first()[0] == 1


def test_snapshots(spark, tmp_path):
    key, other = bytes(range(32)), bytes(32)
    saved = spark.createDataFrame([("s", "[]", {"o": {"k": "v"}}, [("u", "t", 200), ("w", None, 404)], 7)],
                                  "session string, cookies_json string, storage map<string,map<string,string>>, "
                                  "history array<struct<url:string,title:string,status:int>>, history_index long")
    page_io.write_snapshots(saved, str(tmp_path / "snap"), key)
    back = page_io.read_snapshots(spark, str(tmp_path / "snap"), key).cache()
    assert back.first().storage == {"o": {"k": "v"}}
    assert [(r["index"], r.url, r.current) for r in history.restored_history(back).orderBy("index").collect()] == [(0, "u", False), (1, "w", True)]
    assert page_io.read_snapshots(spark, str(tmp_path / "snap"), other).count() == 0
    content = bytes(page_io.encrypt_snapshots(saved, key).first().content)
    newer = spark.range(1).select(F.aes_encrypt(F.lit('{"version":2}').cast("binary"), F.unhex(F.lit(key.hex())), F.lit("GCM"))).first()[0]
    (tmp_path / "raw").mkdir()
    for name, data in (("ok", content), ("short", content[:9]), ("bad", content[:-1] + bytes([content[-1] ^ 1])), ("newer", bytes(newer))):
        (tmp_path / "raw" / name).write_bytes(data)
    found = page_io.read_snapshots(spark, str(tmp_path / "raw"), key, raw_files=True).collect()
    assert [os.path.basename(r.session) for r in found] == ["ok"]


def test_corpus_and_search(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x#f"), (2, "http://b.com:80/")], "page_id long, url string")
    asked = spark.createDataFrame([(1, "https://A.com/x"), (2, "http://b.com"), (3, "http://b.com/none"), (4, "nonsense")], "request_id long, url string")
    found = {r.request_id: (r.page_id, r.code, r.retryable) for r in navigation.fetch_from_corpus(asked, pages).collect()}
    assert found == {1: (1, None, None), 2: (2, None, None), 3: (None, "HTTP_ERROR", True), 4: (None, "INVALID_URL", False)}
    links = spark.createDataFrame([(1, n, "t", f"//d.com/l/?{ad}uddg=https%3A%2F%2Fo.com%2F{n}+%C3%A9&rut=1") for n, ad in enumerate(["", "ad_domain=x&", "", ""])] + [(1, 9, "t", "/plain")],
                                  "page_id long, i int, text string, href string")
    assert [(r.rank, r.url) for r in navigation.search_hits(links, 2).orderBy("rank").collect()] == [(1, "https://o.com/0+é"), (2, "https://o.com/2+é")]


def run(query, timeout=120):
    finished = query.awaitTermination(timeout)
    query.stop()
    assert finished and query.exception() is None


def folders(spark, tmp_path):
    base = f"{checkpoint_dir(spark)}/{tmp_path.name}-{time.time_ns()}"
    return str(tmp_path / "out"), base


def put_files(folder, batches):
    """Log files with distinct times, oldest first."""
    folder.mkdir()
    for n, lines in enumerate(batches):
        path = folder / f"log{n}.jsonl"
        path.write_text("".join(f"{line}\n" for line in lines))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def test_stream_seq_equals_batch(spark, tmp_path):
    batches = [[cmd(5), cmd(3)], ["bad", cmd(6)], [cmd(6, "back"), cmd(9, "quit"), cmd(10)], [cmd(11)]]
    put_files(tmp_path / "in", batches)
    out, checkpoint = folders(spark, tmp_path)
    run(flows.start_file_sink(state.stream_validate_seq(logs.stream_commands(spark, str(tmp_path / "in"))), out, checkpoint))
    streamed = [(r.id, r.accepted, r.reply_seq) for r in spark.read.parquet(out).orderBy("file", "line_no").collect()]
    flat = frame_of(spark, *[line for batch in batches for line in batch])
    batch = [(r.id if not r.bad else None, r.accepted, r.reply_seq) for r in commands.cut_at_quit(commands.validate_seq(commands.parse_commands(flat))).orderBy("line_no").collect()]
    assert streamed == batch


def stream_of(spark, frame, folder, parts=3):
    """A table fed in `parts` files by seq, as a stream."""
    n = frame.count() // parts + 1
    for k in range(parts):
        frame.filter((F.col("seq") >= k * n) & (F.col("seq") < (k + 1) * n)).coalesce(1).write.parquet(f"{folder}/tmp{k}")
        name = next(f for f in os.listdir(f"{folder}/tmp{k}") if f.startswith("part-"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{k}/{name}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_history_and_storage_equal_batch(spark, tmp_path):
    import random

    rng = random.Random(4)
    visits = spark.createDataFrame([(f"s{rng.randrange(2)}", n, rng.choice(["visit", "back", "forward"]), f"u{n}", "t", 200) for n in range(60)],
                                   "session string, seq long, op string, url string, title string, status int")
    (tmp_path / "h").mkdir()
    out, checkpoint = folders(spark, tmp_path)
    run(flows.start_file_sink(state.stream_history(stream_of(spark, visits, str(tmp_path / "h"))), out, checkpoint))
    batch = history.current_page(history.history_positions(visits, SEGMENT)).select("session", "seq", "cursor", "length", "current_url", "code")
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert streamed.count() == 60 and streamed.exceptAll(batch).count() == 0

    items = spark.createDataFrame([("s", n, rng.choice(["set", "get", "delete", "clear"]), "o", f"k{rng.randrange(2)}", f"v{n}") for n in range(60)],
                                  "session string, seq long, op string, origin string, key string, value string")
    (tmp_path / "s").mkdir()
    out, checkpoint = str(tmp_path / "out2"), checkpoint + "-s"
    run(flows.start_file_sink(state.stream_storage(stream_of(spark, items, str(tmp_path / "s"))), out, checkpoint))
    answers = spark.read.parquet(out)
    assert {r.seq: r.value for r in answers.filter("op = 'get'").collect()} == {r.seq: r.value for r in storage.storage_get(items).collect()}
    assert {r.seq: bool(r.n) for r in answers.filter("op = 'delete'").collect()} == {r.seq: r.deleted for r in storage.storage_deletes(items).collect()}
    assert {r.seq: r.n for r in answers.filter("op = 'clear'").collect()} == {r.seq: r.cleared for r in storage.storage_clears(items).collect()}


def test_stream_cookies_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [("s", n, rng.choice(["set", "set", "delete"]), f"n{rng.randrange(2)}", f"v{n}", "a.com", rng.choice(["/", "/p"]), rng.choice([None, 5])) for n in range(60)]
    events = spark.createDataFrame(rows, "session string, seq long, op string, name string, value string, domain string, path string, max_age long") \
        .withColumn("ts", F.timestamp_seconds("seq")).withColumn("secure", F.lit(False)).withColumn("http_only", F.lit(False))
    (tmp_path / "c").mkdir()
    out, checkpoint = folders(spark, tmp_path)
    run(flows.start_file_sink(state.stream_cookies(stream_of(spark, events, str(tmp_path / "c"))), out, checkpoint))
    streamed = {r.seq: r.n > 0 for r in spark.read.parquet(out).filter("op = 'delete'").collect()}
    assert streamed == {r.seq: r.deleted for r in cookies.deleted_flags(events, SEGMENT).collect()}


def test_stream_state_with_time_to_live(spark, tmp_path):
    visits = spark.createDataFrame([("s", n, "visit", f"u{n}") for n in range(6)], "session string, seq long, op string, url string")
    (tmp_path / "t").mkdir()
    out, checkpoint = folders(spark, tmp_path)
    events = stream_of(spark, visits, str(tmp_path / "t"), parts=2)
    query = flows.start_file_sink(state.stream_history(events, ttl_ms=3_600_000), out, checkpoint)
    try:  # a query with a time to live goes on with empty batches, so it is stopped from here
        for _ in range(120):
            time.sleep(0.5)
            if query.exception() or (os.path.isdir(f"{out}/_spark_metadata") and spark.read.schema("seq long, cursor long").parquet(out).count() == 6):
                break
    finally:
        query.stop()
    assert query.exception() is None
    assert [r.cursor for r in spark.read.parquet(out).orderBy("seq").collect()] == list(range(6))


def test_stream_pages_and_snapshots(spark, tmp_path, pages_of):
    secret = "sk-" + "q" * 24
    pages_of("<h1>A</h1>", f"<p>{secret}</p>").coalesce(1).write.parquet(str(tmp_path / "pages"))
    out, checkpoint = folders(spark, tmp_path)
    run(flows.start_page_sink(flows.stream_pages(spark, str(tmp_path / "pages")), flows.redacted_markdown, out, checkpoint))
    found = {r.page_id: r.markdown for r in spark.read.parquet(out).collect()}
    assert found[0] == "# A" and found[1].startswith("${secret_")
    nodes = flows.stream_nodes(flows.stream_pages(spark, str(tmp_path / "pages")), tags=("h1",))
    run(flows.start_file_sink(nodes.filter("tag = 'h1'").select("page_id", "tag"), str(tmp_path / "nodes"), checkpoint + "-n"))
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 1


def test_state_snapshots_write_what_changed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "check")
    rows = [[(f"k{n}", 0, "x" * 50) for n in range(3000)], [("k1", 1, "y")], [("k2", 2, "z"), ("k2", 3, "zz")], [("new", 4, "n")], [("k1", 5, "last")], [("k3", 6, "w")]]
    expected, sizes = {}, []
    for number, batch in enumerate(rows):
        spark.createDataFrame(batch, "k string, seq long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{number}"))
        for part in (tmp_path / "in" / f"b{number}").glob("*.parquet"):
            part.rename(tmp_path / "in" / f"{number}.parquet")
        stream = spark.readStream.schema("k string, seq long, v string").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
        run(flows.start_state_snapshots(stream, table, checkpoint, ["k"], "seq", compact_every=2))
        expected.update({k: v for k, _, v in batch})
        assert {r.k: r.v for r in flows.read_state(spark, table, ["k"], "seq").collect()} == expected
        changed = f"{table}/changes={number}"
        sizes.append(sum(os.path.getsize(f"{changed}/{f}") for f in os.listdir(changed) if f.endswith(".parquet")))
    assert max(sizes[1:]) < sizes[0] / 5
    kept = sorted(d for d in os.listdir(table) if "=" in d)
    assert kept == ["changes=4", "changes=5", "state=3", "state=5"]


def test_tail_serves_complete_lines_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def step(name, data):
        with open(folder / name, "ab") as file:
            file.write(data)
        run(flows.start_file_sink(logs.tail_commands(spark, str(folder), part_bytes=7), out, checkpoint))
        return [(os.path.basename(r.file), r.line_no, r.line) for r in spark.read.parquet(out).orderBy("file", "line_no").collect()]

    assert step("a.log", b'{"id":"1"}\n{"id":') == [("a.log", 0, '{"id":"1"}')]
    first = [("a.log", 0, '{"id":"1"}'), ("a.log", 11, '{"id":"2"}')]
    assert step("a.log", b'"2"}\r\n\xc3') == first
    assert step("b.log", b"\nlong line of words\n") == first + [("b.log", 0, ""), ("b.log", 1, "long line of words")]
    assert step("a.log", b"\xa9\n")[2] == ("a.log", 23, "é") and len(step("b.log", b"")) == 5


class _CountedMap:
    """A map state that counts the messages it is sent."""

    def __init__(self, held):
        self.held, self.asked = dict(held), 0

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        self.asked += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def removeKey(self, key):
        self.asked += 1
        self.held.pop(key, None)

    def iterator(self):
        self.asked += 1
        return iter(list(self.held.items()))


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_folds_ask_the_store_once_per_entry_not_per_row():
    fold = state.StorageFold()
    fold.items = _CountedMap({("old",): ("1",), ("gone",): ("2",)})
    ops = [("get", "old", None), ("delete", "gone", None), ("get", "gone", None)] + [("set", "k", str(n)) for n in range(300)] + [
        ("get", "k", None), ("list", None, None), ("clear", None, None), ("get", "old", None), ("list", None, None), ("set", "k", "last")]
    log = pd.DataFrame([(n, *op) for n, op in enumerate(ops)], columns=["seq", "op", "key", "value"])
    (answers,) = fold.handleInputRows(("s", "o"), iter([log.iloc[::-1]]), None)
    at = answers.set_index("seq")
    assert list(at.value[[0, 303]]) == ["1", "299"] and at.value[[2, 306]].isna().all() and list(at.n[[1, 304, 305, 307]]) == [1, 2, 2, 0]
    assert fold.items.held == {("k",): ("last",)} and fold.items.asked < 12

    fold = state.HistoryFold()
    fold.entries, fold.cursor = _CountedMap({}), _Value()
    moves = [("visit", "/a"), ("visit", "/b")] + [("back", None), ("forward", None)] * 200
    log = pd.DataFrame([(n, *move) for n, move in enumerate(moves)], columns=["seq", "op", "url"])
    (answers,) = fold.handleInputRows(("s",), iter([log]), None)
    assert list(answers.current_url) == ["/a", "/b"] + ["/a", "/b"] * 200 and fold.entries.asked < 8
