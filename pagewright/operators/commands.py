"""Command logs: parsing, order checks, required fields, envelopes and pairing with results.

A log row is (log, line_no, line). `line_no` is the position within the log, written at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.mime import fetch_mode, is_retryable
from pagewright.operators.running import SEGMENT_ROWS, running, segmented

# The actions of a command log and the fields each cannot do without.
ACTIONS = [
    "config", "fetch", "links", "dom_query", "fill", "submit", "cookies", "set_cookie", "delete_cookie",
    "storage_get", "storage_set", "storage_delete", "storage_list", "storage_clear", "history", "back",
    "forward", "info", "quit",
]
REQUIRED = {
    "submit": ["selector"], "set_cookie": ["name", "value", "domain"], "delete_cookie": ["name", "domain"],
    "storage_get": ["key"], "storage_set": ["key", "value"], "storage_delete": ["key"],
}
COMMAND_FIELDS = (
    "id string, v int, seq bigint, action string, url string, `index` bigint, text string, method string, "
    "body string, auth_profile string, headers map<string,string>, selector string, script string, attr string, "
    "value string, fields array<struct<selector:string,value:string,sensitive:boolean>>, key string, origin string, "
    "name string, domain string, path string, secure boolean, http_only boolean, max_age_secs bigint, "
    "sensitive boolean, query string, `limit` bigint, max_tokens bigint, step_delay string, "
    "options struct<max_tokens:bigint,offset:bigint,selector:string,strip_nav:boolean,include_links:boolean,"
    "include_images:boolean,timeout_secs:bigint,compact_links:boolean,show_selectors_first:boolean,download_path:string>")
# HTTP methods a fetch may name.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]


END_MARK = "end of line"
TEXT_FIELDS = [f.split()[0] for f in COMMAND_FIELDS.split(", ") if f.endswith(" string") and f != "step_delay string"]


def _step_delay_ok() -> Column:
    """A number, or an ordered pair of numbers, none of them negative."""
    raw = F.col("step_delay")
    pair = F.from_json(raw, "array<double>")
    single = raw.try_cast("double")
    return raw.isNull() | F.coalesce(single >= 0, F.lit(False)) | F.coalesce(
        raw.startswith("[") & (F.size(pair) == 2) & (pair[0] >= 0) & (pair[0] <= pair[1]), F.lit(False))


def _mistyped() -> Column:
    """Whether the line holds more than one JSON value, or a text field holds something else than text or null.

    The typed reader turns numbers into text. Readers stop behind the first value, so the line is read as the first
    entry of a list whose second must then be the mark put behind it."""
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit(f',"{END_MARK}"]')))
    wrong = ~F.coalesce(F.try_variant_get(whole, "$[1]", "string") == END_MARK, F.lit(False))
    for name in TEXT_FIELDS:
        held = F.try_variant_get(whole, f"$[0].{name}", "variant")
        wrong = wrong | ~F.coalesce(F.schema_of_variant(held).isin("STRING", "VOID"), F.lit(True))
    return wrong


def parse_commands(lines: DataFrame) -> DataFrame:
    """`lines(log, line_no, line)` to command rows; blank lines go, bad ones keep `bad` = true.

    Bad means broken JSON, a wrong type, an unknown action or a missing field. Unknown fields are
    ignored. Works on batch and streaming frames alike.
    """
    parsed = lines.withColumn("line", F.trim(F.regexp_replace("line", r"(?U)\A\s+|\s+\z", ""))).filter("line <> ''").withColumn(
        "_c", F.from_json("line", f"{COMMAND_FIELDS}, _corrupt string",
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.select(*lines.columns, "_c.*", _mistyped().alias("_mistyped"))
    missing = F.lit(False)
    for action, fields in REQUIRED.items():
        for name in fields:
            missing = missing | ((F.col("action") == action) & F.col(name).isNull())
    bad_field = F.exists(F.coalesce("fields", F.array().cast(rows.schema["fields"].dataType)),
                         lambda f: f["selector"].isNull() | f["value"].isNull())
    bad = (F.col("_corrupt").isNotNull() | F.col("_mistyped") | (F.col("v") < 0) | F.col("id").isNull() | F.col("v").isNull() | F.col("seq").isNull()
           | (F.col("seq") < 0) | ~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)) | missing
           | ((F.col("action") == "fill") & bad_field)
           | ((F.col("action") == "fetch") & ~F.coalesce(F.col("method").isin(METHODS), F.lit(True)))
           | ((F.col("action") == "config") & ~_step_delay_ok()))
    return rows.withColumn("bad", F.coalesce(bad, F.lit(True))).drop("_corrupt", "_mistyped")


def validate_seq(commands: DataFrame, segment_rows: int = SEGMENT_ROWS, kept: bool = False) -> DataFrame:
    """Add `last_seq` (highest sequence number before the row) and `accepted`.

    A rejected row never raises the highest number, so it is a running maximum over the log. Bad
    rows do not count; they are answered with `last_seq + 1`, or 0 at the start (`reply_seq`). With `kept` the rows
    stay segmented for further running values.
    """
    log = segmented(commands, "line_no", segment_rows, dense=True)
    seen = running(log, ["log"], "line_no", {"last_seq": ("max", F.when(~F.col("bad"), F.col("seq")))})
    fresh = F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))
    rows = seen.withColumn("accepted", ~F.col("bad") & fresh).withColumn(
        "reply_seq", F.when(F.col("bad"), F.coalesce(F.col("last_seq") + 1, F.lit(0))).otherwise(F.col("seq")))
    return rows if kept else rows.drop("_seg")


def cut_at_quit(validated: DataFrame) -> DataFrame:
    """Rows up to and including the first accepted quit of their log: those with none before them."""
    quits = F.when(F.col("accepted") & (F.col("action") == "quit"), 1)
    return running(validated, ["log"], "line_no", {"_quits": ("sum", quits)}, dense=True).filter("_quits = 0").drop("_quits", "_seg")


def required_fields_code() -> Column:
    """INVALID_COMMAND where an accepted command names no target; null otherwise."""
    action = F.col("action")
    fill_ok = F.col("fields").isNotNull() | (F.col("selector").isNotNull() & F.col("value").isNotNull())
    return F.when((action == "fetch") & fetch_mode("url", "index", "text").isNull(), "INVALID_COMMAND").when(
        (action == "dom_query") & F.col("selector").isNull() & F.col("script").isNull(), "INVALID_COMMAND").when(
        (action == "fill") & ~fill_ok, "INVALID_COMMAND")


def check_commands(lines: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Parsed, ordered and cut log with `code` and `error` for rows that fail before dispatch."""
    rows = cut_at_quit(validate_seq(parse_commands(lines), segment_rows, kept=True)).withColumn("_field", required_fields_code())
    error = (
        F.when(F.col("bad"), F.concat(F.lit("line "), F.col("line_no"), F.lit(": invalid command")))
        .when(~F.col("accepted"), F.concat(F.lit("seq "), F.col("seq"), F.lit(" must be greater than previous seq "), F.col("last_seq")))
        .when(F.col("_field").isNotNull(), F.when(F.col("action") == "fetch", "fetch requires url, index, or text")
              .when(F.col("action") == "dom_query", "dom_query requires selector or script")
              .otherwise("fill requires either selector+value or fields array")))
    return rows.withColumn("error", error).withColumn("code", F.when(error.isNotNull(), "INVALID_COMMAND")).drop("_field")


def envelope(rows: DataFrame, data: Column | None = None) -> DataFrame:
    """(log, line_no, id, ok, seq, error, code, retryable, data, json) result rows.

    `code` null means success; `retryable` is only present on errors, and null members are left
    out of the JSON text.
    """
    ok = F.col("code").isNull()
    data = F.lit(None).cast("string") if data is None else data
    out = rows.select(
        "log", "line_no", F.when(F.col("bad"), "").otherwise(F.col("id")).alias("id"), ok.alias("ok"),
        F.col("reply_seq").alias("seq"), "error", "code", F.when(~ok, is_retryable("code")).alias("retryable"),
        F.when(ok, data).alias("data"))
    head = F.to_json(F.struct("id", "ok", "seq", "error", "code", "retryable"))
    tail = F.when(F.col("data").startswith("{") & (F.length("data") > 2), F.concat(
        F.lit(","), F.substring("data", F.lit(2), F.length("data")))).otherwise("}")
    return out.withColumn("json", F.concat(F.left(head, F.length(head) - 1), tail))


def control_data() -> Column:
    """Payload of the two actions that are answered without a dispatch."""
    return F.when(F.col("action") == "config", '{"status":"configured"}').when(F.col("action") == "quit", '{"status":"quit"}')


def latest_results(results: DataFrame) -> DataFrame:
    """One row per (log, id, seq): the last written (`line_no`) wins on a retry."""
    rest = [c for c in results.columns if c not in ("log", "id", "seq")]
    return results.groupBy("log", "id", "seq").agg(F.max_by(F.struct(*rest), "line_no").alias("r")).select(
        "log", "id", "seq", "r.*")


def match_results(commands: DataFrame, results: DataFrame) -> DataFrame:
    """Commands with the outcome of their latest result."""
    answers = latest_results(results).select("log", "id", "seq", "ok", F.col("code").alias("result_code"))
    return commands.join(answers, ["log", "id", "seq"])


def unanswered(commands: DataFrame, results: DataFrame) -> DataFrame:
    return commands.join(results.select("log", "id", "seq"), ["log", "id", "seq"], "left_anti")


def action_counts(commands: DataFrame) -> DataFrame:
    """(action, n, errors): counts per action and how many were answered with an error."""
    return commands.groupBy("action").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("code").isNotNull(), 1)).alias("errors"))


def error_counts(results: DataFrame) -> DataFrame:
    return results.filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))


def dedup_retries(results: DataFrame) -> DataFrame:
    """The first row of every (log, id): a repeated request gives the same answer again."""
    rest = [c for c in results.columns if c not in ("log", "id")]
    return results.groupBy("log", "id").agg(F.min_by(F.struct(*rest), "line_no").alias("r")).select("log", "id", "r.*")
