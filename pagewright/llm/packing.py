"""Packing of documents into sequences of fixed length with a bounded number of open windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import batches_of, stored
from pagewright.llm.tokens import shared_encoder

LENGTH, OPEN, END = 2048, 16, 1
#: One task merges the leftovers of so many partitions.
MERGED = 64
#: A worker remembers the ids of so many pieces, twice over.
PIECES = 200_000

_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, done boolean, ids binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_()), ("ids", pa.binary())])


class Packer:
    """Keeps `slots` open windows. A piece goes to the window where it leaves least room; when it fits in none
    and all slots are open, the fullest is filled with its head and emitted, and its rest is placed anew."""

    def __init__(self, length: int, slots: int, first_id: int):
        self.length, self.slots, self.next_id = length, slots, first_id
        self.windows: list[tuple[int, list]] = []

    def add(self, doc: tuple, start: int, raw: bytes) -> Iterator[dict]:
        at, size = 0, len(raw) // 4
        while size - at >= self.length:
            yield from self._rows([(doc, start + at, raw[4 * at:4 * (at + self.length)])])
            at += self.length
        while at < size:
            rest = size - at
            fitting = [k for k, (room, _) in enumerate(self.windows) if room >= rest]
            if fitting:
                k = min(fitting, key=lambda k: self.windows[k][0])
                take = rest
            elif len(self.windows) < self.slots:
                k, take = len(self.windows), rest
                self.windows.append((self.length, []))
            else:
                k = min(range(len(self.windows)), key=lambda k: self.windows[k][0])
                take = self.windows[k][0]
            room, held = self.windows[k]
            held.append((doc, start + at, raw[4 * at:4 * (at + take)]))
            self.windows[k] = (room - take, held)
            at += take
            if room == take:
                yield from self._rows(self.windows.pop(k)[1])

    def leftovers(self) -> Iterator[dict]:
        for _, held in self.windows:
            yield from self._rows(held, False)
        self.windows = []

    def cut(self) -> Iterator[dict]:
        """The open windows as sequences whose lengths are powers of two, which need no padding."""
        for room, held in self.windows:
            have, power = self.length - room, self.length
            while have:
                while power > have:
                    power //= 2
                taken, need = [], power
                while need:
                    doc, start, raw = held.pop(0)
                    n = min(need, len(raw) // 4)
                    taken.append((doc, start, raw[:4 * n]))
                    if 4 * n < len(raw):
                        held.insert(0, (doc, start + n, raw[4 * n:]))
                    need -= n
                have -= power
                yield from self._rows(taken)
        self.windows = []

    def _rows(self, pieces: list, done: bool = True) -> Iterator[dict]:
        number, offset = self.next_id, 0
        self.next_id += 1
        for (doc_id, tokens), start, raw in pieces:
            n = len(raw) // 4
            yield {"doc_id": doc_id, "start": start, "length": n, "doc_tokens": tokens, "sequence_id": number, "offset": offset,
                   "done": done, "ids": raw}
            offset += n


def pack(docs: DataFrame, path: str, length: int = LENGTH, slots: int = OPEN, end: int = END) -> DataFrame:
    """Pieces of sequences of (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Every document is its ids and the end id (null text: only that); each id lies in exactly one piece. Every
    partition packs on its own in bounded memory; what its open windows still hold is merged with that of other
    partitions, and what is left then is cut into powers of two, so no sequence has padding. Rows that share a
    doc_id are separate documents; a null doc_id stays null. `length` must be a power of two."""
    if length & (length - 1):
        raise ValueError("the length must be a power of two")
    last = np.array([end], "<u4").tobytes()

    def place(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0

        def rows():
            encoder, packer = shared_encoder(path, PIECES), Packer(length, slots, part << 36)
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    doc_id, raw = doc_id.as_py(), encoder.ids(text.as_py()) + last
                    yield from packer.add((doc_id, len(raw) // 4), 0, raw)
            yield from packer.leftovers()

        return batches_of(rows(), _SCHEMA)

    def merge(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0

        def rows():
            packer = Packer(length, 1, -(part + 1) << 36)
            for batch in batches:
                for r in batch.to_pylist():
                    yield from packer.add((r["doc_id"], r["doc_tokens"]), r["start"], r["ids"])
            yield from packer.cut()

        return batches_of(rows(), _SCHEMA)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(source.mapInArrow(place, _PIECE), "pieces")
    left = pieces.filter("NOT done")
    groups = left.agg(F.countDistinct(F.shiftright("sequence_id", 36))).first()[0]
    merged = left.repartition(max(1, -(-groups // MERGED)), F.floor(F.shiftright("sequence_id", 36) / MERGED)).sortWithinPartitions("sequence_id", "offset")
    return pieces.filter("done").unionByName(merged.mapInArrow(merge, _PIECE)).drop("done")
