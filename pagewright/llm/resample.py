"""Importance resampling towards a target: hashed n-gram buckets, log ratios as integer gains, Gumbel draws.

A document's weight is the sum of the gains of its features' buckets. It is computed bit-sliced: the counts of the
buckets are written as planes of one bit per bucket, the gains as planes of a two's complement; a count plane AND a
gain plane, its bits counted, times the two powers of two, summed over all pairs of planes, is the exact weight.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pagewright.llm.common import stored

BUCKETS, LONGEST_RUN = 10_000, 3
SMOOTHING = 10_000
SCALE = 1000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Rows of a range when drawn documents are numbered.
RANK_ROWS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of 1 to `longest` consecutive words, repeats and all).

    A run's CRC is its beginning's CRC carried on over a space and the next word."""
    words = _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    sums = list(map(crc32, words))
    found, following = list(sums), [b" " + w for w in words]
    for length in range(2, longest + 1):
        sums = list(map(crc32, following[length - 1:], sums))
        found += sums
    return len(words), np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how often all texts together have each bucket; buckets that never occur are left out.

    Each task adds up its own texts, so at most a row per bucket and task is shuffled, however common a feature is."""
    def kernel(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(features(value.as_py())[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.select(text).mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> np.ndarray:
    """Counts of all buckets, at the driver: BUCKETS numbers whatever the corpus."""
    found = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():
        found[row.bucket] = row.n
    return found


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the source), by bucket, in doubles."""
    all_source, all_target = float(int(source.sum()) + SMOOTHING), float(int(target.sum()) + SMOOTHING)
    return np.array([math.floor(scale * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _plane(bits: np.ndarray) -> np.ndarray:
    """One bit per bucket, packed into 64-bit words."""
    packed = np.packbits(bits)
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def gain_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, worth of a bit in each): two's complement, so the last plane counts negatively."""
    width = max(int(np.abs(values).max(initial=0)).bit_length(), 1) + 1
    planes = np.stack([_plane(((values >> j) & 1).astype(bool)) for j in range(width)])
    worth = np.array([1 << j for j in range(width - 1)] + [-(1 << (width - 1))], np.int64)
    return planes, worth


def sliced_weight(buckets: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> int:
    """The sum of gains over a document's features by count planes AND gain planes."""
    if not len(buckets):
        return 0
    counts, weight = np.bincount(buckets, minlength=BUCKETS), 0
    for i in range(int(counts.max()).bit_length()):
        both = planes & _plane(((counts >> i) & 1).astype(bool))
        weight += int(np.bitwise_count(both).sum(axis=1, dtype=np.int64) @ worth) << i
    return weight


def weights(docs: DataFrame, values: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row by the gains of the buckets; null texts have no features."""
    planes, worth = gain_planes(values)
    names = ["n_words", "n_features", "weight"]

    def kernel(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words, buckets = features(value.as_py())
                rows.append((words, len(buckets), sliced_weight(buckets, planes, worth)))
            numbers = [pa.array(column, pa.int64()) for column in (zip(*rows) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], ["doc_id", *names])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    return docs.select("doc_id", "text").mapInArrow(kernel, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's own Gumbel number, floored after scaling, from a hash of the seed and its id; null for a null id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(weighted: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row: `rank` numbers the drawn ones from 1, null elsewhere.

    The highest `percent` percent of scores are drawn among the documents of at least `least_words` words, ties
    going to smaller ids and then to earlier rows. A row without an id has no score and is never drawn nor counted.
    Rows are ordered by ranges; a range is numbered by itself and starts where the ranges before it, counted, end, so
    neither a task nor the driver sees the order as a whole. Ranges behind the last drawn row are not numbered."""
    rows = stored(weighted.withColumn("score", F.col("weight") + noise(F.col("doc_id")))
                  .withColumn("row", F.monotonically_increasing_id()), "weights")
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    out = ["doc_id", "n_features", "weight", "score"]
    candidates = rows.filter(fit)
    total = candidates.count()
    drawn = percent * total // 100
    unfit = rows.filter(~fit).select(*out, F.lit(None).cast("long").alias("rank"))
    placed = stored(candidates.repartitionByRange(max(1, -(-total // rank_rows)), *order)
                    .withColumn("part", F.spark_partition_id()), "ranges")
    starts, at = [], 0
    for row in sorted(placed.groupBy("part").count().collect()):  # a row per `rank_rows` documents
        starts.append((row.part, at))
        at += row["count"]
    reached = F.broadcast(rows.sparkSession.createDataFrame([s for s in starts if s[1] < drawn], "part int, first long"))
    number = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = placed.join(reached, "part").withColumn("rank", number).select(
        *out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    beyond = placed.join(reached, "part", "left_anti").select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(beyond).unionByName(unfit)


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Documents weighted and drawn towards the distribution of the target's texts: see `draw`.

    An empty table gives an empty result; an empty target prefers rare features. Further columns are left behind."""
    values = gains(_dense(bucket_counts(docs)), _dense(bucket_counts(target)))
    return draw(weights(docs, values))
