"""Near-duplicate vectors by a small-world graph per shard that every vector of the label queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import components, stored
from pagewright.llm.hnsw import Graph

COSINE = 0.98
#: Different vectors in a shard; queries at once; queries that an audit draws; the recall of links it asks for.
SHARD, QUERIES, PROBES, RECALL = 8192, 256, 64, 0.999
#: So many nearest nodes of each drawn query are looked for, and this share has to be found.
NEAREST, NEAREST_RECALL = 10, 0.98
#: At most so many tasks search shard pairs.
MOST_TASKS = 100_000
#: First width of the beams.
WIDTH = 32

_SHARD_SQL = "label long, dim int, shard int, ids binary, copies binary, vectors binary, layers array<binary>"
_FOUND_SQL = "vec_id long, other long, n long"


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


class Shard:
    """A shard's row with its graph read back."""

    def __init__(self, row: dict, prefix: str = ""):
        self.ids = np.frombuffer(row[prefix + "ids"], "<i8")
        self.copies = np.frombuffer(row[prefix + "copies"], "<i8")
        self.vectors = np.frombuffer(row[prefix + "vectors"], "<f8").reshape(len(self.ids), -1)
        if not prefix:
            self.graph = Graph(self.vectors[:0])
            self.graph.vectors = self.vectors
            self.graph.layers = [np.frombuffer(raw, "<i8").reshape(len(self.ids), -1) for raw in row["layers"]]


def linked(graph: Graph, queries: np.ndarray, least: float, width: int, recall: float = RECALL, probes: int = PROBES,
           told: dict | None = None):
    """For each query the nodes with a cosine of at least `least` (computed in double precision), as (query, node).

    An audit holds `probes` drawn queries against brute force: of their NEAREST nearest nodes the graph must find the
    share NEAREST_RECALL, and of their links the share `recall`; else all beams double. So every shard pair is audited,
    whether it has links or not. A search as wide as the shard that still fails is replaced by brute force. `told`
    receives the width, the beams searched and the recalls."""
    n, pool = len(graph.vectors), np.random.default_rng(5).permutation(len(queries))[:probes]
    told = {} if told is None else told
    if not n or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cosine = queries[pool] @ graph.vectors.T
    wanted = min(NEAREST, n)
    # The least cosine of the nearest ones: whichever of equal ones a search finds is right.
    limit = -np.partition(-cosine, wanted - 1, axis=1)[:, wanted - 1] - 1e-9
    q, v = _near(queries[pool], graph.vectors, least)
    while True:
        ids, near = graph.search(queries[pool], width)
        close = float(np.minimum((near >= limit[:, None]).sum(1), wanted).sum() / (wanted * len(pool)))
        found_q, found_v = _range(graph, queries[pool], least, width)
        links = float(np.isin(q * n + v, found_q * n + found_v).mean()) if len(q) else 1.0
        told.update(width=width, nearest=close, links=links, probed=len(pool))
        if close >= NEAREST_RECALL and links >= recall:
            told["beams"] = len(queries)
            return _range(graph, queries, least, width)
        if width >= n:
            told["beams"] = 0
            return _brute(graph, queries, least)
        width *= 2


def _range(graph: Graph, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that beams find. A query whose whole beam is near has more than the beam holds: it is held against the
    whole shard, which is bounded."""
    out_q, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(queries), QUERIES):
        todo = np.arange(at, min(at + QUERIES, len(queries)))
        ids, near = graph.search(queries[todo], width)
        full = (near >= least - 1e-9).all(1) & (near.shape[1] < len(graph.vectors))
        q, k = np.nonzero((near >= least - 1e-9) & ~full[:, None])
        sure = np.einsum("ed,ed->e", queries[todo[q]], graph.vectors[ids[q, k]]) >= least
        out_q.append(todo[q[sure]])
        out_v.append(ids[q, k][sure])
        if full.any():
            q, v = _near(queries[todo[full]], graph.vectors, least)
            out_q.append(todo[full][q])
            out_v.append(v)
    return np.concatenate(out_q), np.concatenate(out_v)


def _near(queries: np.ndarray, vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs; those next to the limit are computed as searches compute them."""
    cosine = queries @ vectors.T
    q, v = np.nonzero(cosine >= least - 1e-9)
    sure = cosine[q, v] >= least + 1e-9
    edge = np.flatnonzero(~sure)
    sure[edge] = np.einsum("ed,ed->e", queries[q[edge]], vectors[v[edge]]) >= least
    return q[sure], v[sure]


def _brute(graph: Graph, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_near(queries[at:at + QUERIES], graph.vectors, least) for at in range(0, len(queries), QUERIES)]
    return np.concatenate([p[0] + k * QUERIES for k, p in enumerate(pairs)]), np.concatenate([p[1] for p in pairs])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what was apart, so as many as there are nodes at most."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label), one row per row given.

    Equal vectors of a label are one node with a number of copies. A label's nodes are dealt to shards of bounded
    size, each with a graph; each shard's nodes query every shard of the label and the same dimension. Of the links
    a search finds, only counts and a spanning forest leave the task. Rows with a null id, label or vector, a null
    or non-finite component, or length zero link with nothing: n_links 0, component_id their own id, kept. Rows
    that share a vec_id are one node."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
           & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
           & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False)))
    fits = rows.filter(fit)
    nodes = stored(fits.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
                   .withColumn("dim", F.size("v")), "vectors")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", "v"), F.col("shards")).cast("int"))

    def build(table):
        raw = np.array(table["v"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        order = np.argsort(np.array(table["rep"]), kind="stable")
        # Scaled first, so that squares neither overflow nor vanish.
        raw = raw[order] / np.abs(raw[order]).max(1, keepdims=True)
        graph = Graph(_unit(raw))
        return pa.table({
            "label": table["label"][:1], "dim": table["dim"][:1], "shard": table["shard"][:1],
            "ids": pa.array([np.array(table["rep"])[order].astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([np.array(table["copies"])[order].astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([graph.vectors.astype("<f8").tobytes()], pa.binary()),
            "layers": pa.array([[layer.astype("<i8").tobytes() for layer in graph.layers]], pa.list_(pa.binary()))})

    shards = stored(dealt.select("label", "dim", "shard", "rep", "copies", "v").groupBy("label", "dim", "shard").applyInArrow(build, _SHARD_SQL), "graphs")
    asked = shards.select("label", "dim", F.col("ids").alias("q_ids"), F.col("copies").alias("q_copies"), F.col("vectors").alias("q_vectors"))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                there, here = Shard(row), Shard(row, "q_")
                q, v = linked(there.graph, here.vectors, least, WIDTH)
                other = here.ids[q] != there.ids[v]
                q, v = q[other], v[other]
                count = np.bincount(q, weights=there.copies[v], minlength=len(here.ids)).astype(np.int64)
                forest = _forest(here.ids[q], there.ids[v])
                yield pa.RecordBatch.from_arrays([
                    pa.array(here.ids.tolist() + [a for a, _ in forest], pa.int64()), pa.array([None] * len(here.ids) + [b for _, b in forest], pa.int64()),
                    pa.array(count.tolist() + [0] * len(forest), pa.int64())], ["vec_id", "other", "n"])

    # The number of pairs is told, else small pairs are put into one task again.
    tasks = shards.groupBy("label", "dim").agg((F.count("*") * F.count("*")).alias("n")).agg(F.sum("n")).first()[0] or 1
    pairs = shards.join(asked, ["label", "dim"]).repartition(min(tasks, MOST_TASKS), "label", "dim", F.xxhash64("ids"), F.xxhash64("q_ids"))
    found = stored(pairs.mapInArrow(search, _FOUND_SQL), "found")
    joined = components(found.filter("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    linked_to = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    told = nodes.select("label", "v", F.col("rep").alias("vec_id"), "copies").join(linked_to, "vec_id", "left").join(
        joined.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    with_links = fits.join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_links.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
