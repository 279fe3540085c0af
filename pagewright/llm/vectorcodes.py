"""Vectors as short codes: each part of a vector is named by the nearest entry of its position's codebook.

Components become integers, and a block of vectors is kept as dictionary codes: for every dimension the distinct integers
of the block and each vector's place among them. A round tabulates, per dimension, the squared differences of those
distinct integers to all codebook entries once; the distance of a part is then gathered from the tables of its
dimensions by the codes and added up, without a look at the vector itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewright.llm.common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a block; a block's codes take two bytes each.
BLOCK = 4096
#: Integers beyond this would make squared distances leave a long.
MOST = 1 << 27


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>): scaled and floored vectors without null or non-finite components."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= MOST / SCALE, F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & whole).select(
        "vec_id", "label", scaled.alias("v"))


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Rows in blocks: (vec_id array, label array, dicts, codes), a dictionary and the codes of each dimension in bytes."""
    schema = T.StructType([
        T.StructField("vec_id", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("label", T.ArrayType(rows.schema["label"].dataType)),
        T.StructField("dicts", T.ArrayType(T.BinaryType())), T.StructField("codes", T.ArrayType(T.BinaryType()))])

    def block(table: pa.Table) -> pa.RecordBatch:
        ids, labels, vectors = (table.column(k).combine_chunks() for k in range(3))
        values = np.asarray(vectors.flatten(), np.int64).reshape(len(table), dims)
        dicts, codes = [], []
        for d in range(dims):
            distinct, at = np.unique(values[:, d], return_inverse=True)
            dicts.append(distinct.astype("<i8").tobytes())
            codes.append(at.astype("<u2").tobytes())
        ends = pa.array([0, len(table)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels),
             pa.array([dicts], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], ["vec_id", "label", "dicts", "codes"])

    def kernel(batches):
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if count + piece.num_rows > BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, count = [], 0
                held.append(piece)
                count += piece.num_rows
        if count:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(kernel, schema)


def assign(dicts: list[np.ndarray], codes: list[np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of one part of all vectors of a block; ties go to the lower entry.

    `dicts` and `codes` are those of the part's dimensions, `book` its entries by dimension."""
    total = None
    for d, (distinct, at) in enumerate(zip(dicts, codes)):
        table = (distinct[:, None] - book[None, :, d]) ** 2
        if int(table.max()) * len(dicts) < 1 << 31:  # half the memory traffic
            table = table.astype(np.int32)
        total = table[at] if total is None else total + table[at]
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(nearest)), nearest].astype(np.int64)


def _unpacked(row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(b, "<i8") for b in row["dicts"]], [np.frombuffer(b, "<u2") for b in row["codes"]]


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts assigned to them; unused entries stay.

    A task adds up its blocks, so a row per entry and dimension and task is shuffled, and as many rows as the
    codebooks have numbers reach the driver, however many vectors there are."""
    parts, entries, width = books.shape

    def kernel(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                dicts, codes = _unpacked(row)
                for p in range(parts):
                    here = slice(p * width, (p + 1) * width)
                    nearest, _ = assign(dicts[here], codes[here], books[p])
                    counts[p] += np.bincount(nearest, minlength=entries)
                    for d, (distinct, at) in enumerate(zip(dicts[here], codes[here])):
                        np.add.at(sums[p, :, d], nearest, distinct[at])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
             pa.array(np.tile(np.arange(width), len(part)), pa.int32()), pa.array(sums[part, entry].ravel(), pa.int64()),
             pa.array(np.repeat(counts[part, entry], width), pa.int64())], ["part", "entry", "dim", "total", "n"])

    partial = blocks.select("dicts", "codes").mapInArrow(kernel, "part int, entry int, dim int, total long, n long")
    found = books.copy()
    for row in partial.groupBy("part", "entry", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        found[row.part, row.entry, row.dim] = row.total // row.n
    return found


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""
    parts, _, width = books.shape
    types = {f.name: f.dataType.elementType for f in blocks.schema if f.name in ("vec_id", "label")}
    schema = T.StructType([*(T.StructField(n, types[n]) for n in ("vec_id", "label")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def kernel(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                dicts, codes = _unpacked(row.select(["dicts", "codes"]).to_pylist()[0])
                found = [assign(dicts[p * width:(p + 1) * width], codes[p * width:(p + 1) * width], books[p]) for p in range(parts)]
                digits = np.stack([nearest.astype(np.uint8) for nearest, _ in found], axis=1)
                error = sum(distance for _, distance in found)
                yield pa.RecordBatch.from_arrays(
                    [row.column("vec_id").flatten(), row.column("label").flatten(),
                     pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(kernel, schema)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """(stored blocks, final codebooks by part, entry and position), or None if no vector is kept.

    The first codebooks are the parts of the `entries` smallest vec_ids (null ids last; of one id given twice the
    smaller vector first), fewer if there are fewer vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    rows = _integers(vectors).filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dims = len(first[0].v)
    rows = rows.filter(F.size("v") == dims)
    start = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    blocks = stored(_blocks(rows, dims), "blocks")
    for _ in range(rounds):
        books = refined(blocks, books)
    return blocks, books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row of `vectors(vec_id, label, embedding)`.

    Rows without a vector or with a null or non-finite component are dropped, and so are vectors that cannot be cut into
    equal parts, that have another length than the vector of the smallest vec_id, or a component beyond 2^19, whose
    squares would leave a long. Null and repeated vec_ids are rows like others; null labels are one
    label. An empty table gives an empty result. Errors of a label are summed before they are shuffled, and the join back
    meets one row per label, so a label may hold most rows."""
    learnt = learn(vectors, parts, entries, rounds)
    if learnt is None:
        return _integers(vectors).limit(0).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(_coded(*learnt), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(learnt[1])).alias("codebooks_sha256"))
