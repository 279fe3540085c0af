"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The relations are kept in columns: a row holds the different n-grams of one block of documents that fall into one
part of the count table, as an array of 64-bit names, with their counts as a second array. Grouping these rows by
part sums the counts, joining the sums back by block gives each block the counts of its n-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import WordHashes, mixed, sized, windows_hashed
from pagewright.llm.decontaminate import words_of

ORDER, BACKOFF, LEAST_COUNT = 2, 0.4, 2
#: A block holds documents of about so many characters, a part of the count table about so many.
BLOCK_CHARS, PART_CHARS = 6_000_000, 100_000_000
PARTS = 48
#: Decimal places of scores, so that they do not depend on the order of additions.
PLACES = 6

_SENT = "part int, block long, names binary, counts binary"
_BACK = "block long, part int, counts binary"


def grams(texts: list, order: int, hashes: WordHashes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length 1..order the names of the n-grams that end at each word (0 where the document has begun
    later), then the words' documents and places."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    hashed = np.concatenate([hashes.of(w) for w in words]) if words else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(hashed)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for n in range(1, order + 1):
        names = np.zeros(len(hashed), np.uint64)
        if len(hashed) >= n:
            names[n - 1:] = windows_hashed(hashed, n)
        out.append(np.where(place >= n - 1, names, np.uint64(0)))
    return out, doc, place


def _parts_of(names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings names by part, and where each part begins."""
    part = (mixed(names) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _different(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, counts = np.unique(np.concatenate([f[f != 0] for f in found]), return_counts=True)
    return names, counts


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least_count: int = LEAST_COUNT,
           block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS, parts: int = PARTS) -> DataFrame:
    """(doc_id, n_words, score, mean_score), one row per row of (doc_id, text).

    Words are those of decontamination (A-Z lowered). The score is the sum over words of the natural logarithm of
    S(w | context): the count of the longest n-gram that ends at w, by that of its context, times `backoff` for
    each word that the context was shortened by. Counts are over all rows; n-grams of two and more words that
    occur less than `least_count` times are left out of the table, single words never, so no score is infinite.
    A word alone is its count by that of all words. No words: score 0, mean null. Rows that share a doc_id are
    separate documents; null ids stay."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = F.coalesce(F.length("text"), F.lit(0)) + 16
    blocks = sized(source, chars, block_chars)
    parts = sized(source, chars, part_chars, parts)
    placed = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def count(table):
        found, _, _ = grams(table["text"].to_pylist(), order, WordHashes())
        names, counts = _different(found)
        by, cuts = _parts_of(names, parts)
        rows = [(p, by[cuts[p]:cuts[p + 1]]) for p in range(parts) if cuts[p + 1] > cuts[p]]
        return pa.table({
            "part": pa.array([p for p, _ in rows], pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int64()),
            "names": pa.array([names[k].tobytes() for _, k in rows], pa.binary()),
            "counts": pa.array([counts[k].astype("<u4").tobytes() for _, k in rows], pa.binary())})

    def add(table):
        names = [np.frombuffer(raw, np.uint64) for raw in table["names"].to_pylist()]
        every = np.concatenate(names)
        counts = np.concatenate([np.frombuffer(raw, "<u4") for raw in table["counts"].to_pylist()])
        _, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, weights=counts)[inverse]
        cuts = np.cumsum([0] + [len(n) for n in names])
        sums = [np.minimum(total[a:b], 0xFFFFFFFF).astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"block": table["block"], "part": table["part"], "counts": pa.array(sums, pa.binary())})

    counted = placed.groupBy("block").applyInArrow(count, _SENT)
    sums = counted.groupBy("part").applyInArrow(add, _BACK)
    total = _all_words(source)

    def score(table, told):
        if not table.num_rows:
            return _scored([], np.empty(0, np.int64), np.empty(0))
        found, doc, _ = grams(table["text"].to_pylist(), order, WordHashes())
        names, _ = _different(found)
        by, cuts = _parts_of(names, parts)
        counts = np.zeros(len(names), np.float64)
        for part, raw in zip(told["part"].to_pylist(), told["counts"].to_pylist()):
            counts[by[cuts[part]:cuts[part + 1]]] = np.frombuffer(raw, "<u4")

        def of(gram):
            return np.where(gram != 0, counts[np.minimum(np.searchsorted(names, gram), len(names) - 1)], 0.0)

        n = len(doc)
        value = np.log(of(found[0]) / max(total, 1)) + (order - 1) * math.log(backoff) if n else np.empty(0)
        place = np.arange(n) - np.searchsorted(doc, doc)
        # A document's first words have no longer context, so nothing is taken off for what is not there.
        value = value - math.log(backoff) * np.maximum(0, order - 1 - place) if n else value
        for k in range(2, order + 1):
            if not n:
                break
            whole = of(found[k - 1])
            context = np.concatenate([[0.0], of(found[k - 2])[:-1]])
            seen = whole >= least_count
            lost = np.minimum(order - 1, place) - (k - 1)
            value = np.where(seen, np.log(np.where(seen, whole, 1.0) / np.maximum(context, 1.0)) + lost * math.log(backoff), value)
        size = table.num_rows
        return _scored(table["doc_id"].to_pylist(), np.bincount(doc, minlength=size), np.bincount(doc, weights=value, minlength=size))

    return placed.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, score double, mean_score double")


def _all_words(source: DataFrame) -> int:
    """The number of all words."""
    lone = F.regexp_count(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    return source.agg(F.sum(lone)).first()[0] or 0


def _scored(ids: list, words: np.ndarray, sums: np.ndarray) -> pa.Table:
    mean = [round(s / n, PLACES) if n else None for s, n in zip(sums.tolist(), words.tolist())]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()),
                     "score": pa.array(np.round(sums, PLACES), pa.float64()), "mean_score": pa.array(mean, pa.float64())})
