"""Removal of long repeated word sequences, found by recompression.

Every text is rewritten in two rounds: runs of equal symbols get one name, then pairs of neighbours of which the
first falls in the left and the second in the right half of all names. A name is the hash of what it stands for,
so all tasks agree on names without asking each other, and what a round does at a place depends on few words
around it, whose range is carried along. Equal sequences therefore get equal symbols in their interior, and a
border between two of these symbols lies at the same place in each copy.

Every window of words is represented by one such border inside it: that whose surrounding phrase has the smallest
name. A first exchange tells which phrases occur in several blocks of documents; only windows that they represent
are exchanged in a second one, whole, which tells exactly which windows occur in documents of smaller id."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from pagewright.llm.common import MIX, WordHashes, in_sorted, kept, mixed, sized, windows_hashed

WINDOW = 13
#: Words on either side of a border that make up its phrase.
REACH = 4
ROUNDS = 2
#: A block is a range of doc_ids with about so many characters; a part of an exchange covers about so many.
BLOCK_CHARS, PART_CHARS = 4_000_000, 100_000_000
PARTS = 48
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+, unchanged, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Symbols:
    """A sequence of named symbols over words: extents, and the words on which each symbol and border depends."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        self.name, self.doc = words, doc
        self.start, self.end = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        self.low, self.high = self.start, self.end
        inner = np.empty(n, bool)
        if n:
            inner[:-1], inner[-1] = doc[:-1] == doc[1:], False
        # Border k stands behind symbol k. The end of a document is seen only from beyond it.
        self.inner, self.b_low, self.b_high = inner, self.end, np.where(inner, self.end, self.end + 1)

    def _fold(self, join: np.ndarray, need_low: np.ndarray, need_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins symbols k and k+1 where told; a border that stays depends on the needed range besides its own."""
        b_low, b_high = np.minimum(self.b_low, need_low), np.maximum(self.b_high, need_high)
        b_low[~self.inner], b_high[~self.inner] = self.b_low[~self.inner], self.b_high[~self.inner]
        head = np.concatenate([[True], ~join[:-1]])
        first = np.flatnonzero(head)
        last = np.concatenate([first[1:] - 1, [len(join) - 1]])
        before = first - 1
        starts_doc = (before < 0) | ~self.inner[before]
        left_low = np.where(starts_doc, self.start[first] - 1, b_low[before])
        left_high = np.where(starts_doc, self.start[first], b_high[before])
        low = np.minimum.reduceat(self.low, first)
        high = np.maximum.reduceat(self.high, first)
        self.low, self.high = np.minimum(np.minimum(low, left_low), b_low[last]), np.maximum(np.maximum(high, left_high), b_high[last])
        self.start, self.end, self.doc = self.start[first], self.end[last], self.doc[first]
        self.inner, self.b_low, self.b_high = self.inner[last], b_low[last], b_high[last]
        return first, last

    def round(self, number: int) -> None:
        if not len(self.name):
            return
        after = np.append(np.arange(1, len(self.name)), 0)
        same = self.inner & (self.name == self.name[after])
        first, last = self._fold(same, np.minimum(self.low, self.low[after]), np.maximum(self.high, self.high[after]))
        count = (last - first + 1).astype(np.uint64)
        self.name = np.where(count > 1, mixed(self.name[first] ^ mixed(count)), self.name[first])

        after = np.append(np.arange(1, len(self.name)), 0)
        right = (mixed(self.name + np.uint64(number)) >> np.uint64(63)).astype(bool)
        pair = self.inner & ~right & right[after]
        # A border before a left symbol stays whatever stands before it; before a right one, a right one must stand.
        both = right[after]
        need_low = np.where(both, np.minimum(self.low, self.low[after]), self.low[after])
        need_high = np.where(both, np.maximum(self.high, self.high[after]), self.high[after])
        names = mixed(self.name * MIX + self.name[after])
        old, (first, last) = self.name, self._fold(pair, need_low, need_high)
        self.name = np.where(last > first, names[first], old[first])


class Block:
    """Documents of one block: hashes of words, windows, and the phrase that represents each window.

    Words are cut of one text at a time and not kept: as objects they would take more room than all the rest."""

    def __init__(self, texts: list, doc_ids: list, size: int, hashes: WordHashes):
        hashed = [hashes.of(words_of(t)) for t in texts]
        self.lengths = np.array([len(h) for h in hashed], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.hashed = np.concatenate(hashed) if len(texts) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        self.size, self.ids = size, doc_ids
        n = max(0, len(self.hashed) - size + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:size - 1 + n]).astype(np.int32)
        self.windows = windows_hashed(self.hashed, size)[self.at]

    def keys(self) -> np.ndarray:
        """Of each window the smallest name of a phrase around a border that the window's own words fix; of a
        window without one, its own name."""
        best = np.full(len(self.at), _NONE)
        if self.size >= 2 * REACH and len(self.hashed) >= 2 * REACH:
            symbols = Symbols(self.hashed, self.doc)
            for number in range(1, ROUNDS + 1):
                symbols.round(number)
            place = symbols.end[symbols.inner]
            ok = (place >= REACH) & (place + REACH <= len(self.hashed))
            place, low, high = place[ok], symbols.b_low[symbols.inner][ok], symbols.b_high[symbols.inner][ok]
            phrase = np.full(len(self.hashed) + 1, _NONE)
            phrase[place] = windows_hashed(self.hashed, 2 * REACH)[place - REACH]
            least, most = np.zeros(len(phrase), np.int32), np.full(len(phrase), -1, np.int32)
            least[place], most[place] = np.maximum(high, place + REACH) - self.size, np.minimum(low, place - REACH)
            for offset in range(REACH, self.size - REACH + 1):
                p = self.at + offset
                fits = (least[p] <= self.at) & (self.at <= most[p])
                best = np.where(fits, np.minimum(best, phrase[p]), best)
        return np.where(best == _NONE, mixed(self.windows), best)

    def repeated_within(self) -> np.ndarray:
        """Windows that start in a document of smaller id of this block."""
        order = {i: k for k, i in enumerate(sorted({i for i in self.ids if i is not None}))}
        rank = np.array([order.get(i, len(order)) for i in self.ids], np.int64)[self.doc[self.at]] if len(self.at) else np.empty(0, np.int64)
        by = np.lexsort((rank, self.windows))
        group = np.cumsum(np.concatenate([[True], self.windows[by][1:] != self.windows[by][:-1]])) - 1 if len(by) else by
        least = rank[by][np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])] if len(by) else by
        out = np.zeros(len(by), bool)
        if len(by):
            out[by] = least[group] < rank[by]
        return out

    def covered(self, removed: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.hashed) + 1, np.int64)
        np.add.at(step, self.at[removed], 1)
        np.add.at(step, self.at[removed] + self.size, -1)
        return np.cumsum(step[:-1]) > 0


_SENT = "part int, block long, names binary"
_BACK = "block long, names binary"


def _sent(block: int, names: np.ndarray, parts: int) -> pa.Table:
    """Different names, by the part that their hash puts them in."""
    names = np.unique(names)
    part = (mixed(names) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(p, names[order[cuts[p]:cuts[p + 1]]].tobytes()) for p in range(parts) if cuts[p + 1] > cuts[p]]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()),
                     "names": pa.array([r[1] for r in rows], pa.binary())})


def _answer(table: pa.Table, choose) -> pa.Table:
    """Back to each block those of its names that are chosen by (names, blocks), both sorted by name and block."""
    blocks = np.concatenate([np.full(len(raw) // 8, b, np.int64) for b, raw in zip(table["block"].to_pylist(), table["names"].to_pylist())])
    names = np.concatenate([np.frombuffer(raw, np.uint64) for raw in table["names"].to_pylist()])
    order = np.lexsort((blocks, names))
    names, blocks = names[order], blocks[order]
    chosen = choose(names, blocks)
    names, blocks = names[chosen], blocks[chosen]
    order = np.lexsort((names, blocks))
    names, blocks = names[order], blocks[order]
    at, first = np.unique(blocks, return_index=True)
    stops = np.append(first[1:], len(blocks))
    return pa.table({"block": pa.array(at, pa.int64()), "names": pa.array([names[a:b].tobytes() for a, b in zip(first, stops)], pa.binary())})


def _firsts(names: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place where its run of equal values begins."""
    head = np.concatenate([[True], names[1:] != names[:-1]])
    return np.maximum.accumulate(np.where(head, np.arange(len(names)), 0))


def _names_of(table: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(raw, np.uint64) for raw in table["names"].to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _in_blocks(docs: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """Documents with __block, a range of doc_ids, and the number of blocks. Null ids are dealt by text to further blocks."""
    blocks = sized(docs, F.coalesce(F.length("text"), F.lit(0)) + 16, block_chars)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 50 * blocks)).first()[0] if blocks > 1 else []
    borders = np.array(sorted(cuts or []), np.int64)

    @pandas_udf("long")
    def range_of(doc_id):
        return pd.Series(np.searchsorted(borders, doc_id.to_numpy(np.int64), side="left"))

    far = blocks + F.pmod(F.xxhash64("text"), F.lit(blocks))
    return docs.withColumn("__block", F.when(F.col("doc_id").isNull(), far).otherwise(range_of(F.coalesce("doc_id", F.lit(0))))), blocks


def without_repeats(docs: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS,
                    parts: int = PARTS) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words that no removed window covers, joined by one space.

    A window is `size` consecutive words of a text; it is removed when the same words also start in a document of
    smaller doc_id, judged on the input. Texts shorter than a window, empty and null texts (no words) lose nothing.
    Rows that share a doc_id do not remove each other's words. A row with a null doc_id removes nothing elsewhere
    and loses what occurs in any document that has an id. doc_id must be a whole number. Columns of the result's
    names are replaced; all others are kept."""
    added = ["n_words", "n_removed", "kept_text"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added]).withColumn("doc_id", F.col("doc_id").cast("long"))
    placed, blocks = _in_blocks(docs, block_chars)
    parts = sized(docs, F.coalesce(F.length("text"), F.lit(0)), part_chars, parts)

    def made(table):
        return Block(table["text"].to_pylist(), table["doc_id"].to_pylist(), size, kept("words", WordHashes))

    def post(table):
        return _sent(table["__block"][0].as_py(), made(table).keys(), parts)

    def reveal(table):
        def shared(names, _):
            first = _firsts(names)
            count = np.bincount(first, minlength=len(names))
            return count[first] > 1
        return _answer(table, shared)

    def verify(table, told):
        if not table.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "names": pa.array([], pa.binary())})
        block = made(table)
        return _sent(table["__block"][0].as_py(), block.windows[in_sorted(block.keys(), _names_of(told))], parts)

    def decide(table):
        def later(names, at):
            least = at[_firsts(names)]
            return (least < at) & (least < blocks)
        return _answer(table, later)

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    shape = docs.columns

    def remove(table, told):
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in table.schema if f.name != "__block"} | {
                "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        block = made(table)
        gone = block.covered(block.repeated_within() | in_sorted(block.windows, _names_of(told)))
        removed, left = [], []
        for text, at, n in zip(table["text"].to_pylist(), block.offsets, block.lengths):
            words, out = words_of(text), gone[at:at + n]
            removed.append(int(out.sum()))
            left.append(b" ".join([w for w, g in zip(words, out) if not g] if removed[-1] else words).decode("utf-8", "surrogatepass"))
        columns = {c: table[c] for c in shape}
        return pa.table(columns | {"n_words": pa.array(block.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                                   "kept_text": pa.array(left, pa.string())})

    grouped = placed.groupBy("__block")
    shared = grouped.applyInArrow(post, _SENT).groupBy("part").applyInArrow(reveal, _BACK)
    checked = grouped.cogroup(shared.groupBy("block")).applyInArrow(verify, _SENT)
    later = checked.groupBy("part").applyInArrow(decide, _BACK)
    return grouped.cogroup(later.groupBy("block")).applyInArrow(remove, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
