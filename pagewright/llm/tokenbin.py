"""Token ids in a binary file format of directly addressable codes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pagewright.llm.common import batches_of, sized, stored
from pagewright.llm.tokens import shared_encoder

END = 1
#: A file holds whole documents until it has this many ids or more; a part of the id range has about so many characters.
FILE_IDS, PART_CHARS = 1 << 19, 12_000_000
#: A level's bits are counted up to every BLOCK-th one.
BLOCK = 512
_MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    """Ids as levels of 8-bit chunks, low chunk first. An id with more chunks has its continuation bit set and
    its next chunk stands in the next level at the rank of that bit.

    Layout: magic, number of levels, then per level its length, chunks, bits (little-endian in bytes, padded to
    whole blocks) and the rank directory (set bits before each block)."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return _MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Reads a file of encode(): any token by its position, without decoding what stands before it."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (count,), at, self.levels = struct.unpack_from("<I", raw, 4), 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<I", raw, at)
            chunks = np.frombuffer(raw, np.uint8, n, at + 4)
            at += 4 + n
            blocks = -(-n // BLOCK)
            bits = np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at)
            at += len(bits)
            ranks = np.frombuffer(raw, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, position: int) -> int:
        """Set bits before a position: the directory's count and those of one block at most."""
        _, bits, ranks = self.levels[level]
        block, within = divmod(position, BLOCK)
        found = int(ranks[block])
        if within:
            part = np.unpackbits(bits[block * BLOCK // 8:block * BLOCK // 8 + -(-within // 8)], count=within, bitorder="little")
            found += int(part.sum())
        return found

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions start..stop-1, from that part of each level alone."""
        out = np.zeros(stop - start, np.uint32)
        where, low, high = np.arange(stop - start), start, stop
        for level, (chunks, bits, _) in enumerate(self.levels):
            if high <= low:
                break
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            first = low // 8
            more = np.unpackbits(bits[first:-(-high // 8)], bitorder="little")[low - 8 * first:high - 8 * first].astype(bool)
            where = where[more]
            low = self._rank(level, low)
            high = low + len(where)
        return out

    def __getitem__(self, position: int) -> int:
        if not 0 <= position < len(self):
            raise IndexError(position)
        return int(self.slice(position, position + 1)[0])


_FILE = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])


def write_files(docs: DataFrame, path: str, end: int = END, file_ids: int = FILE_IDS, part_chars: int = PART_CHARS) -> DataFrame:
    """Ids of all documents in ascending doc_id order as files, one row of a stored table each.

    A document is the ids of its whole text (null: none) and the end id. part is a range of doc_ids, file numbers
    its files, first counts the part's ids before the file. Null ids come first; rows that share an id follow each
    other, ordered by their texts' hashes. Texts are sorted once and tokenized once, where they then lie. An empty
    table makes no file."""
    parts = sized(docs, F.coalesce(F.length("text"), F.lit(0)) + 16, part_chars)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text")).repartitionByRange(
        parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    last = np.array([end], "<u4").tobytes()

    def kernel(batches):
        context = TaskContext.get()
        part = context.partitionId() if context else 0

        def rows():
            encoder = shared_encoder(path)
            held, lengths, doc_ids, n, first, file = [], [], [], 0, 0, 0
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    raw = encoder.ids(text) + last
                    held.append(raw)
                    doc_ids.append(doc_id)
                    lengths.append(len(raw) // 4)
                    n += len(raw) // 4
                    if n >= file_ids:
                        yield _file(part, file, first, doc_ids, lengths, held)
                        first, file, n = first + n, file + 1, 0
                        held, lengths, doc_ids = [], [], []
            if held:
                yield _file(part, file, first, doc_ids, lengths, held)

        return batches_of(rows(), _FILE, 16)

    return stored(ordered.select("doc_id", "text").mapInArrow(
        kernel, "part int, file int, first long, doc_ids array<long>, lengths array<long>, codes binary"), "files", "zstd")


def _file(part, file, first, doc_ids, lengths, held) -> dict:
    return {"part": part, "file": file, "first": first, "doc_ids": doc_ids, "lengths": lengths,
            "codes": encode(np.frombuffer(b"".join(held), "<u4"))}


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document read back by its position; start counts all ids before it.

    The ids before a part are a running sum over parts. That is a row of two numbers for each PART_CHARS characters and sent to
    every task, since Spark guesses its size from the files' and would shuffle their codes; all else stays where it is."""
    totals = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def kernel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                # All documents of a file are wanted, so its levels are read once and cut by position.
                whole, at = Codes(row["codes"]).slice(0, sum(row["lengths"])).astype("<u4"), 0
                starts, ids = [], []
                for n in row["lengths"]:
                    starts.append(row["before"] + row["first"] + at)
                    ids.append(whole[at:at + n].tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(F.broadcast(before), "part").select("before", "first", "doc_ids", "lengths", "codes").mapInArrow(
        kernel, "doc_id long, start long, n_tokens long, ids binary")
