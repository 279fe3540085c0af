"""Local storage as keyed state over an event log.

`events(session, seq, op, origin, key, value)`, op one of `set`, `get`, `delete`, `clear`,
`list`. Last write wins per (session, origin, key); a clear ends all keys of its origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.urls import origin as origin_of
from pagewright.operators.running import SEGMENT_ROWS, running, segmented
from pagewright.operators.secrets import resolve_handles

SCOPE = ["session", "origin"]
ITEM = ["session", "origin", "key"]


def storage_state(events: DataFrame) -> DataFrame:
    """(session, origin, key, value) alive at the end. Only aggregates with map-side combine run
    over the events; the join meets one row per key with one row per origin."""
    clears = events.filter("op = 'clear'").groupBy(*SCOPE).agg(F.max("seq").alias("_cleared"))
    writes = events.filter("op IN ('set', 'delete')").groupBy(*ITEM).agg(
        F.max("seq").alias("_at"), F.max_by(F.struct("op", "value"), "seq").alias("_w"))
    live = (F.col("_w.op") == "set") & (F.col("_at") > F.coalesce("_cleared", F.lit(-1)))
    return writes.join(clears, SCOPE, "left").filter(live).select(*ITEM, F.col("_w.value").alias("value"))


def _with_past(events: DataFrame, segment_rows: int) -> DataFrame:
    """Events with `_cleared`, the last earlier clear of the origin, and `_w`, the last earlier write of the key.

    One exchange by origin serves both: a key's rows lie where its origin's do."""
    log = segmented(events.select("session", "seq", "op", "origin", "key", "value"), "seq", segment_rows)
    cleared = running(log, SCOPE, "seq", {"_cleared": ("last", F.when(F.col("op") == "clear", F.col("seq")))})
    write = F.when(F.col("op").isin("set", "delete"), F.struct("seq", "op", "value"))
    return running(cleared, ITEM, "seq", {"_w": ("last", write)})


def _was_live() -> Column:
    return F.coalesce((F.col("_w.op") == "set") & (F.col("_w.seq") > F.coalesce("_cleared", F.lit(-1))), F.lit(False))


def storage_get(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(session, seq, origin, key, value) for every read: the value as of it, null if missing."""
    return _with_past(events, segment_rows).filter("op = 'get'").select(
        "session", "seq", "origin", "key", F.when(_was_live(), F.col("_w.value")).alias("value"))


def storage_list(state: DataFrame) -> DataFrame:
    """(session, origin, entries, count)."""
    return state.groupBy(*SCOPE).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("entries"), F.count("*").alias("count"))


def storage_deletes(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(session, seq, origin, key, deleted) for every delete."""
    return _with_past(events, segment_rows).filter("op = 'delete'").select(
        "session", "seq", "origin", "key", _was_live().alias("deleted"))


def storage_clears(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(session, seq, origin, cleared): live keys each clear removed.

    Between two clears the number of keys is a sum of births and deaths, so it is one aggregate
    per stretch instead of a scan of the keys at every clear.
    """
    change = F.when((F.col("op") == "set") & ~_was_live(), 1).when((F.col("op") == "delete") & _was_live(), -1)
    since = F.coalesce("_cleared", F.lit(-1))
    clear = F.col("op") == "clear"
    # A clear and the changes since the one before it share a stretch, so they meet in one aggregate.
    return (_with_past(events, segment_rows).withColumn("_change", change).groupBy(*SCOPE, since.alias("_since")).agg(
        F.coalesce(F.sum("_change"), F.lit(0)).alias("cleared"), F.max(F.when(clear, F.col("seq"))).alias("seq"))
        .filter("seq IS NOT NULL").select("session", "seq", "origin", "cleared"))


def with_origin(events: DataFrame) -> DataFrame:
    """Fill the origin from the current page (`current_url`, see `history.current_page`); `code`
    is NO_PAGE where there is none, SESSION_ERROR where the page has no origin."""
    own = origin_of("current_url")
    missing = F.col("origin").isNull()
    code = F.when(missing & F.col("current_url").isNull(), "NO_PAGE").when(missing & own.isNull(), "SESSION_ERROR")
    return events.withColumn("storage_code", code).withColumn("origin", F.coalesce("origin", own))


def merge_snapshot(rules: list[tuple[str, str, str]], snapshot: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Configured entries (origin, key, value) against restored `snapshot(session, origin, key,
    value)`: a configured entry wins and exists in every session, those of `sessions(session)` that restored
    nothing included."""
    presets = F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(k).alias("key"), F.lit(v).alias("value"))
                        for o, k, v in rules])
    every = snapshot.select("session")
    every = (every if sessions is None else every.union(sessions.select("session"))).distinct()
    loaded = every.select("session", F.inline(presets), F.lit(1).alias("_prio"))
    return snapshot.select(*ITEM, "value", F.lit(0).alias("_prio")).unionByName(loaded).groupBy(*ITEM).agg(
        F.max_by("value", "_prio").alias("value"))


def resolved_for_saving(state: DataFrame, vault: DataFrame) -> DataFrame:
    """State with handles turned back into secrets before it is written to a snapshot."""
    keyed = state.withColumn("_key", F.to_json(F.struct(*ITEM)))
    return resolve_handles(keyed, "value", vault, "_key").drop("_key")
