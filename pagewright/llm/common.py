"""Helpers of the corpus operators: stored intermediate tables, word hashes, blocks of documents, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.session import checkpoint_dir

MIX = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, name: str, compression: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """The frame written as a table in the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor costs a read. The folder's owner clears it after the job. group_rows bounds the rows of a
    row group, which is written and read as a whole: for rows of several MB, of which Spark would gather a hundred unasked."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    written = df.write.option("compression", compression)
    (written.option("parquet.block.row.count.limit", group_rows) if group_rows else written).parquet(path)
    return df.sparkSession.read.parquet(path)


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 2048, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Row dicts gathered into Arrow batches of bounded rows and bytes."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if len(held) >= size or held_bytes >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def sized(df: DataFrame, amount: Column, per_part: int, least: int = 1) -> int:
    """How many parts of about `per_part` the summed amount makes."""
    total = df.agg(F.sum(amount)).first()[0] or 0
    return max(least, -(-int(total) // per_part))


#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 512
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. Spark's 10,000 rows are a task's whole share of the texts, which would lie in the JVM's
    buffers, the worker's and its lists, and again on the way back."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)


@contextmanager
def batches_at_most(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the Arrow batches of the jobs that run inside the block; afterwards the session has its own bound again."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


_KEPT: dict = {}


def kept(name: Hashable, make: Callable):
    """What a worker process remembers from task to task. One thing at a time: who asks for another gets the room of the former,
    so a job of several operators holds no more in a worker than the largest of them."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()  # an encoder and its pieces name each other
        _KEPT[name] = make()
    return _KEPT[name]


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words met lately (at most `most`)."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hashed(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive word hashes (empty when there are fewer).

    The words' hashes are the digits of a number to an odd base, which is scrambled once."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out *= MIX
        out += words[k:k + n]
    return mixed(out)


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the values occur in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for every node that has an edge.

    Labels spread along the edges and then jump to the label of their label, so chains halve each round.
    A hub's neighbours are combined before the shuffle; only a count of changes reaches the driver."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
                    .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"))
        near = stored(labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")), "labels")
        jump = near.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = stored(near.join(jump, F.col("label") == F.col("at")).select("node", "old", F.col("next").alias("label")), "labels")
        if not labels.filter("old <> label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
