"""Benchmark decontamination over a positional inverted index of the training texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import BATCH_ROWS, batches_at_most, batches_of, stored

WINDOW = 10
#: A shard of the index holds documents of about so many characters; one text is never split.
SHARD_CHARS = 8_000_000
#: Test windows are searched in blocks of at most so many, so what a task is sent has a bound.
BLOCK_WINDOWS = 200_000
#: Places left free between documents, so that no match runs from one into the next.
GAP = 1000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lowering A-Z. In UTF-8 these are runs of digits, letters and bytes from 80."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


_SHARD = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                    ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
_SHARD_SQL = "shard long, doc_ids array<long>, text_hashes array<long>, lengths array<int>, terms array<binary>, counts array<int>, postings binary"


def build_index(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A stored table of index shards over (doc_id, text).

    A shard lists its documents with their word counts, its terms with their counts, and the postings: for each
    term the places where it occurs, ascending, as 32-bit integers. A place counts words from the shard's first
    document on, with a gap after each document. Documents are indexed where they are read, so nothing is shuffled; null and empty texts are
    documents without words; rows that share a doc_id are separate documents. A shard has a row group of its own, so a task that writes
    or reads the table holds one shard at a time however many its split has."""
    def kernel(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0

        def rows():
            number, seen, held, doc_ids, marks, chars = 0, {}, [], [], [], 0
            for batch in batches:
                for doc_id, text, mark in zip(*(column.to_pylist() for column in batch.columns)):
                    words = words_of(text)
                    doc_ids.append(doc_id)
                    marks.append(mark)
                    held.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
                    chars += len(text or "") + 80
                    if chars >= shard_chars:
                        yield _shard((part << 32) + number, doc_ids, marks, held, seen)
                        number, seen, held, doc_ids, marks, chars = number + 1, {}, [], [], [], 0
            if doc_ids:
                yield _shard((part << 32) + number, doc_ids, marks, held, seen)

        return batches_of(rows(), _SHARD, 1)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))
    with batches_at_most(docs.sparkSession, BATCH_ROWS):
        return stored(source.mapInArrow(kernel, _SHARD_SQL), "index", group_rows=1)


def _shard(number: int, doc_ids: list, marks: list, held: list, seen: dict) -> dict:
    ids = np.concatenate(held) if held else np.empty(0, np.int32)
    order = np.argsort(ids, kind="stable")
    moved = np.arange(len(ids)) + GAP * np.repeat(np.arange(len(held)), [len(h) for h in held])
    places = moved[order].astype("<i4")
    return {"shard": number, "doc_ids": doc_ids, "text_hashes": marks, "lengths": [len(h) for h in held], "terms": list(seen),
            "counts": np.bincount(ids, minlength=len(seen)).tolist(), "postings": places.tobytes()}


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_ids, terms): each different run of `size` consecutive words of (item_id, text), with the items it stands in.

    An item of fewer words, but not none, is one window. Null texts and ids give none."""
    def kernel(batches):
        for batch in batches:
            ids, terms = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for k in range(max(1, len(words) - size + 1) if words and item_id is not None else 0):
                    ids.append(item_id)
                    terms.append(words[k:k + size])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    source = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(kernel, "item_id string, terms array<binary>").groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))


_HIT = pa.schema([("shard", pa.int64()), ("doc", pa.int32()), ("item_ids", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())),
                  ("stops", pa.list_(pa.int32()))])


def matches(index: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(shard, doc, item_ids, starts, stops): of each document (its number in the shard) that some window occurs in,
    the items with such windows and the word spans that occurrences cover, merged.

    Exact phrases for slop 0; else proximity: each of a window's terms within `slop` words of its place beside the
    window's rarest term, in the same document. A window's terms are taken from the rarest in the whole index on;
    their lists, moved by their offsets, are intersected until none is left. Windows with a term that the index
    lacks cannot occur and are not sent. Windows are searched in blocks of a fixed number, each a broadcast of
    bounded size and a pass over the index; a block's findings are merged with the others'. They are stored, since
    shards go to the workers one by one, which is a bound of the session while the search runs."""
    with batches_at_most(items.sparkSession, BATCH_ROWS):
        found = stored(windows(items, size), "windows")
    if not 0 <= slop < GAP // 2 - size:
        raise ValueError("slop is too large")
    terms = found.select(F.explode("terms").alias("term")).distinct()
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.counts").alias("n")).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    total = found.count()
    blocks = max(1, -(-total // block))
    placed = found.select("item_ids", "terms", F.pmod(F.hash("terms"), F.lit(blocks)).alias("block"))
    frames = []
    for number in range(blocks):
        mine = placed.filter(F.col("block") == number).select("item_ids", "terms")
        frequency = {bytes(r.term): r.n for r in counts.join(mine.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").collect()}
        sent = []
        for r in mine.toLocalIterator():
            terms_ = [bytes(t) for t in r.terms]
            if all(t in frequency for t in terms_):
                order = sorted(range(len(terms_)), key=lambda k: (frequency[terms_[k]], k))
                sent.append((list(r.item_ids), [(terms_[k], k) for k in order], len(terms_)))
        shared = index.sparkSession.sparkContext.broadcast(sent)
        frames.append(index.mapInArrow(_searcher(shared, slop), "shard long, doc int, item_ids array<string>, starts array<int>, stops array<int>"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    with batches_at_most(index.sparkSession, 1):
        out = stored(out, "hits")
    return out if blocks == 1 else out.groupBy("shard", "doc").agg(
        F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("stops")).alias("stops"))


def _searcher(shared, slop: int):
    def kernel(batches):
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from _search(batch.slice(k, 1).to_pylist()[0], shared.value, slop)

        return batches_of(rows(), _HIT)

    return kernel


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which wanted places have one of the sorted places within slop."""
    at = np.searchsorted(places, wanted - slop)
    ok = at < len(places)
    ok[ok] = places[at[ok]] <= wanted[ok] + slop
    return ok


def _search(row: dict, wanted: list, slop: int):
    lengths = np.array(row["lengths"], np.int64)
    first = np.cumsum(lengths + GAP) - lengths - GAP
    stops = np.cumsum(np.array(row["counts"], np.int64))
    number = {t: k for k, t in enumerate(row["terms"])}
    postings = np.frombuffer(row["postings"], "<i4")
    found: dict[int, tuple[set, list]] = {}

    def places(term):
        k = number[term]
        return postings[stops[k] - row["counts"][k]:stops[k]]

    for item_ids, order, size in wanted:
        if any(t not in number for t, _ in order):
            continue
        starts = places(order[0][0]).astype(np.int64) - order[0][1]
        for term, offset in order[1:]:
            starts = starts[_near(places(term), starts + offset, slop)]
            if not len(starts):
                break
        docs = np.searchsorted(first, starts + order[0][1], side="right") - 1
        for doc, start in zip(docs.tolist(), (starts - first[docs]).tolist()):
            items, spans = found.setdefault(doc, (set(), []))
            items.update(item_ids)
            spans.append((max(start - slop, 0), min(start + size + slop, row["lengths"][doc])))
    for doc, (items, spans) in found.items():
        merged = []
        for start, stop in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        yield {"shard": row["shard"], "doc": doc, "item_ids": sorted(items), "starts": [m[0] for m in merged], "stops": [m[1] for m in merged]}


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated; one row per row given.

    n_hit counts words inside any occurrence of a window, n_items the items whose windows occur; without any the
    digest is that of the empty text."""
    index = build_index(docs)
    hits = matches(index, items, size)
    listed = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "lengths")).alias("doc", "d")).select(
        "shard", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_hashes").alias("text_hash"), F.col("d.lengths").cast("long").alias("n_words"))
    # Spans of several blocks may overlap: they are sorted and swept.
    spans = F.array_sort(F.arrays_zip("starts", "stops"))
    swept = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stops"] - F.greatest(a["to"], s["starts"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["stops"]).alias("to")))["n"]
    told = hits.select("shard", "doc", swept.alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return listed.join(told, ["shard", "doc"], "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("item_ids", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
