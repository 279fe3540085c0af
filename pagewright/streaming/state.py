"""Keyed state over command and session streams. The steps are those of the batch folds.

Every processor sorts the rows of a micro-batch by their place in the log before applying them:
files of one trigger may arrive in any order. State lives as long as its key unless `ttl_ms` is
given: then what was not written for that long is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators.commands import parse_commands
from pagewright.operators.history import move

_CODES = {"visit": 0, "back": 1, "forward": 2}


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, ignore_index=True)


class _Keyed(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: _Keyed, schema: str) -> DataFrame:
    mode = "none" if processor.ttl_ms is None else "processingTime"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode)


class SeqCheck(_Keyed):
    """State: highest accepted sequence number and whether the log has quit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("log", "last_seq bigint, done boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        last, done = self.state.get() if self.state.exists() else (None, False)
        out = []
        for row in _in_order(rows, ["file", "line_no"]).itertuples(index=False):
            if done:
                break
            fresh = not row.bad and (last is None or row.seq > last)
            reply = row.seq if not row.bad else (0 if last is None else last + 1)
            out.append((key[0], row.file, row.line_no, row.id if not row.bad else None, int(reply), row.action, fresh))
            if fresh:
                last = int(row.seq)
                done = row.action == "quit"
        self.state.update((last, done))
        yield pd.DataFrame(out, columns=["log", "file", "line_no", "id", "reply_seq", "action", "accepted"])


def stream_validate_seq(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming order check of `stream_commands` rows, cut at the first accepted quit."""
    parsed = parse_commands(lines).select("log", "file", "line_no", "id", F.coalesce("seq", F.lit(-1)).alias("seq"), "action", "bad")
    return _run(parsed, ["log"], SeqCheck(ttl_ms), "log string, file string, line_no int, id string, reply_seq bigint, action string, accepted boolean")


class _Held:
    """A map state as it is within one batch of a key: every entry is asked of the store once, and what was changed is
    written at the end. Each question to the store is a message to another process, so there is none per row."""

    def __init__(self, state):
        self.state, self.now, self.changed, self.whole = state, {}, {}, False

    def get(self, key: tuple) -> tuple | None:
        if key not in self.now:
            self.now[key] = tuple(self.state.getValue(key)) if not self.whole and self.state.containsKey(key) else None
        return self.now[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """None takes the entry away."""
        self.now[key] = self.changed[key] = value

    def load(self) -> dict:
        """The live entries, all of them."""
        if not self.whole:
            for key, value in self.state.iterator():
                self.now.setdefault(tuple(key), tuple(value))
            self.whole = True
        return {key: value for key, value in self.now.items() if value is not None}

    def save(self) -> None:
        for key, value in self.changed.items():
            if value is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class HistoryFold(_Keyed):
    """State: cursor and one entry per depth. A visit overwrites its depth; deeper ones are dead."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "depth bigint, ahead bigint", self.ttl_ms)
        self.entries = handle.getMapState("entries", "depth bigint", "url string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        depth, ahead = self.cursor.get() if self.cursor.exists() else (0, 0)
        out, entries = [], _Held(self.entries)
        for row in _in_order(rows, ["seq"]).itertuples(index=False):
            code = _CODES.get(row.op, 3)
            before = depth
            depth, ahead = move(depth, ahead, code)
            if code == 0:
                entries.put((depth,), (row.url,))
            # An entry may have outlived its time under a cursor that is still in use: its address is unknown then.
            entry = entries.get((depth,)) if depth else None
            url = entry[0] if entry else None
            out.append((key[0], row.seq, depth - 1, depth + ahead, url,
                        "NO_HISTORY" if code in (1, 2) and depth == before else None))
        entries.save()
        self.cursor.update((depth, ahead))
        yield pd.DataFrame(out, columns=["session", "seq", "cursor", "length", "current_url", "code"])


def stream_history(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(session, seq, cursor, length, current_url, code) per event of a stream of session events."""
    kind = events.schema["session"].dataType.simpleString()
    return _run(events.select("session", "seq", "op", "url"), ["session"], HistoryFold(ttl_ms),
                f"session {kind}, seq bigint, cursor bigint, length bigint, current_url string, code string")


class StorageFold(_Keyed):
    """State: the live values of one (session, origin)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "key string", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out, items = [], _Held(self.items)
        for row in _in_order(rows, ["seq"]).itertuples(index=False):
            value, n = None, None
            if row.op == "set":
                items.put((row.key,), (row.value,))
                value = row.value
            elif row.op == "get":
                found = items.get((row.key,))
                value = found[0] if found else None
            elif row.op == "delete":
                n = int(items.get((row.key,)) is not None)
                items.put((row.key,), None)
            elif row.op in ("clear", "list"):
                live = items.load()
                n = len(live)
                if row.op == "clear":
                    for held in live:
                        items.put(held, None)
            out.append((*key, row.seq, row.op, row.key, value, n))
        items.save()
        yield pd.DataFrame(out, columns=["session", "origin", "seq", "op", "key", "value", "n"])


def stream_storage(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Answers per storage event: the value of a set or get, the count of a delete, clear or list."""
    kind = events.schema["session"].dataType.simpleString()
    return _run(events.select("session", "origin", "seq", "op", "key", "value"), ["session", "origin"], StorageFold(ttl_ms),
                f"session {kind}, origin string, seq bigint, op string, key string, value string, n bigint")


class CookieFold(_Keyed):
    """State: cookies of one session. Expiry is judged when a cookie is read, as in the batch jar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jar = handle.getMapState("jar", "domain string, path string, name string", "value string, until double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for row in _in_order(rows, ["seq"]).itertuples(index=False):
            now = row.at
            if row.op == "set":
                until = now + row.max_age if pd.notna(row.max_age) else float("inf")
                self.jar.updateValue((row.domain, row.path, row.name), (row.value, until))
                n = 1
            else:
                n = 0
                for (domain, path, name), (_, until) in list(self.jar.iterator()):
                    if row.op == "list":
                        n += until > now
                    elif (domain, name) == (row.domain, row.name):
                        n += until > now
                        self.jar.removeKey((domain, path, name))
            out.append((key[0], row.seq, row.op, n))
        yield pd.DataFrame(out, columns=["session", "seq", "op", "n"])


def stream_cookies(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Answers per cookie event (`set`, `delete`, `list`): how many cookies it touched or listed."""
    kind = events.schema["session"].dataType.simpleString()
    rows = events.select("session", "seq", F.col("ts").cast("double").alias("at"), "op", "name", "value", "domain", "path",
                         F.col("max_age").cast("double").alias("max_age"))
    return _run(rows, ["session"], CookieFold(ttl_ms), f"session {kind}, seq bigint, op string, n bigint")
