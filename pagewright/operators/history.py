"""Browsing history folded from an ordered event log.

A visit cuts everything after the cursor and appends; back and forward move the cursor within
bounds. Input: `events(session, seq, op, url, title, status)`, op one of `visit`, `back`,
`forward`; other ops pass through without effect. Only successful fetches are visits.

The cursor depends on the whole past of a session, and one session may hold most of the log, so
it is computed in three steps over bounded segments: each segment is summarized as a function
from "depth before it" to "depth after it", the summaries are chained per session, and each
segment is replayed from its known start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.operators.running import SEGMENT_ROWS, running

# Long runs between two bounds are replayed in segments of this many events.
FOLD_ROWS = 16384


def _code() -> Column:
    return F.when(F.col("op") == "visit", 0).when(F.col("op") == "back", 1).when(F.col("op") == "forward", 2).otherwise(3)


def move(depth, ahead, code):
    """One step of the fold. `depth` counts entries up to the cursor, `ahead` those after it."""
    if code == 0:
        return depth + 1, 0
    if code == 1 and depth > 1:
        return depth - 1, ahead + 1
    if code == 2 and ahead > 0:
        return depth + 1, ahead - 1
    return depth, ahead


def _summary(codes: list[int]):
    """Moves before the first visit, then end (depth, ahead) by depth at that visit.

    Far from the bottom a segment only shifts the depth, so the table ends at the deepest drop.
    """
    first = codes.index(0) if 0 in codes else len(codes)
    runs = []
    for code in codes[:first]:
        if code in (1, 2):
            step = 1 if code == 2 else -1
            if runs and (runs[-1] > 0) == (step > 0):
                runs[-1] += step
            else:
                runs.append(step)
    if first == len(codes):
        return runs, [], []
    far = 1 << 40
    depth, ahead, lowest = far, 0, far
    for code in codes[first:]:
        depth, ahead = move(depth, ahead, code)
        lowest = min(lowest, depth)
    depths = np.arange(far - lowest + 2, dtype=np.int64)
    aheads = np.zeros_like(depths)
    for code in codes[first:]:
        if code == 0:
            depths += 1
            aheads[:] = 0
        elif code == 1:
            step = depths > 1
            depths -= step
            aheads += step
        elif code == 2:
            step = aheads > 0
            depths += step
            aheads -= step
    return runs, depths.tolist(), aheads.tolist()


def _per_batch(batches: Iterator[pa.RecordBatch], step, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Feed rows in order to `step(row) -> output row or None`, one output batch per input batch."""
    for batch in batches:
        rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) if (out := step(row)) is not None]
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, schema)], schema=schema)


def _summarize(batches, schema):
    """One row per segment. Rows come sorted by (session, segment, seq); a segment is bounded."""
    held: list = [None, None, []]  # session, segment, codes

    def flush():
        return None if held[1] is None else (held[0], held[1], *_summary(held[2]))

    def step(row):
        session, seg, code = row
        done = None
        if (session, seg) != (held[0], held[1]):
            done = flush()
            held[:] = [session, seg, []]
        held[2].append(code)
        return done

    yield from _per_batch(batches, step, schema)
    last = flush()
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(last, schema)], schema=schema)


def _chain(batches, schema):
    """Start state of every segment. Rows come sorted by (session, segment); only the state of the
    current session is held, never a session's rows."""
    state: list = [None, 0, 0]  # session, depth, ahead

    def step(row):
        session, seg, runs, depths, aheads = row
        if session != state[0]:
            state[:] = [session, 0, 0]
        _, depth, ahead = state
        start = (session, seg, depth, ahead)
        for run in runs:
            if run > 0:
                room = min(run, ahead)
                depth, ahead = depth + room, ahead - room
            elif depth > 1:
                room = min(-run, depth - 1)
                depth, ahead = depth - room, ahead + room
        if depths:
            at = min(depth, len(depths) - 1)
            depth, ahead = depths[at] + depth - at, aheads[at]
        state[1:] = [depth, ahead]
        return start

    yield from _per_batch(batches, step, schema)


def _replay(batches, schema):
    """Cursor after every event. Rows come sorted by (session, segment, seq) with the start state."""
    state: list = [None, None, 0, 0]  # session, segment, depth, ahead

    def step(row):
        session, seg, seq, code, depth, ahead = row
        if (session, seg) != (state[0], state[1]):
            state[:] = [session, seg, depth, ahead]
        before = state[2]
        state[2:] = move(state[2], state[3], code)
        return session, seq, state[2] - 1, state[2] + state[3], state[2] != before

    yield from _per_batch(batches, step, schema)


def _ordered_map(rows: DataFrame, keys: list[str], order: list[str], kernel, columns: str, select: list[str]) -> DataFrame:
    """Run a kernel over rows hashed by `keys` and sorted by `order` within each partition."""
    spec = T._parse_datatype_string(columns)
    schema = to_arrow_schema(spec)
    ready = rows.repartition(*keys).sortWithinPartitions(*order).select(*select)
    return ready.mapInArrow(lambda batches: kernel(batches, schema), spec)


def history_positions(events: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """`events` with `cursor` and `length` after each event (-1 and 0 while empty) and `code`,
    NO_HISTORY where back or forward had nowhere to go."""
    kind = events.schema["session"].dataType.simpleString()
    segment = ["session", "_seg"]
    narrow = events.select("session", "seq", _code().alias("code"), F.floor(F.col("seq") / fold_rows).cast("bigint").alias("_seg"))
    parts = _ordered_map(narrow, segment, [*segment, "seq"], _summarize,
                         f"session {kind}, _seg bigint, runs array<bigint>, depths array<bigint>, aheads array<bigint>",
                         [*segment, "code"])
    starts = _ordered_map(parts, ["session"], segment, _chain, f"session {kind}, _seg bigint, depth bigint, ahead bigint",
                          [*segment, "runs", "depths", "aheads"])
    positions = _ordered_map(narrow.join(starts, segment), segment, [*segment, "seq"], _replay,
                             f"session {kind}, seq bigint, cursor bigint, length bigint, moved boolean",
                             [*segment, "seq", "code", "depth", "ahead"])
    stuck = F.col("op").isin("back", "forward") & ~F.col("moved")
    return events.join(positions, ["session", "seq"]).withColumn(
        "code", F.when(stuck, "NO_HISTORY")).drop("moved")


def current_page(positions: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`positions` with the page under the cursor after each event: the last one visited at that
    depth (anything older at the same depth has been cut away)."""
    page = F.when(F.col("op") == "visit", F.struct("url", "title", "status"))
    found = running(positions, ["session", "cursor"], "seq", {"_page": ("last", page)}, inclusive=True,
                    segment_rows=segment_rows)
    return found.select(*positions.columns, F.col("_page.url").alias("current_url"),
                        F.col("_page.title").alias("current_title"), F.col("_page.status").alias("current_status"))


def final_state(positions: DataFrame) -> DataFrame:
    """(session, history_index, history_length) after the last event."""
    last = F.max_by(F.struct("cursor", "length"), "seq").alias("s")
    return positions.groupBy("session").agg(last).select(
        "session", F.col("s.cursor").alias("history_index"), F.col("s.length").alias("history_length"))


def history(positions: DataFrame) -> DataFrame:
    """(session, index, url, title, status, current): the entries left at the end of the log."""
    entry = F.max_by(F.struct("url", "title", "status"), "seq").alias("e")
    visits = positions.filter("op = 'visit'").groupBy("session", F.col("cursor").alias("index")).agg(entry)
    return visits.join(final_state(positions), "session").filter("index < history_length").select(
        "session", "index", "e.url", "e.title", "e.status", (F.col("index") == F.col("history_index")).alias("current"))


def history_search(entries: DataFrame, query: str | None, limit: int = 10) -> DataFrame:
    """Newest matches per session with `count` (returned) and `total` (all entries, unfiltered)."""
    if query is None:
        hit = F.lit(True)
    else:
        needle = F.lower(F.lit(query))
        hit = F.lower("url").contains(needle) | F.coalesce(F.lower("title").contains(needle), F.lit(False))
    totals = entries.groupBy("session").agg(
        F.count("*").alias("total"), F.least(F.sum(hit.cast("bigint")), F.lit(limit)).alias("count"))
    newest = Window.partitionBy("session").orderBy(F.desc("index"))
    # a rank filter on its own lets Spark cut each task to `limit` rows before the shuffle
    top = entries.filter(hit).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)
    return top.join(totals, "session")


def session_info(positions: DataFrame, cookie_counts: DataFrame) -> DataFrame:
    """(session, current_url, title, history_length, history_index, cookies_count)."""
    now = history(positions).filter("current").select("session", F.col("url").alias("current_url"), "title")
    return (final_state(positions).join(now, "session", "left")
            .join(cookie_counts.select("session", "cookies_count"), "session", "left")
            .select("session", "current_url", "title", "history_length",
                    F.greatest("history_index", F.lit(0)).alias("history_index"),
                    F.coalesce("cookies_count", F.lit(0)).alias("cookies_count")))


def restored_history(snapshots: DataFrame) -> DataFrame:
    """History rows of loaded snapshots (session, history, history_index); the index is clamped
    to the last entry."""
    rows = snapshots.select("session", "history_index", F.size("history").alias("n"), F.posexplode("history").alias("index", "h"))
    return rows.select("session", F.col("index").cast("bigint").alias("index"), "h.url", "h.title", "h.status",
                       (F.col("index") == F.least(F.col("history_index"), F.col("n") - 1)).alias("current"))
