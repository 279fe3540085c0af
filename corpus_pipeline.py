"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import decontaminate, langid, minhash, packing, substrings
from pagewright.llm.common import in_small_batches, read, stored
from pagewright.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same_row(keys: DataFrame, docs: DataFrame):
    """Rows of a decision and of documents that speak of the same document; null ids are equal."""
    return keys.key_id.eqNullSafe(docs.doc_id) & (keys.key_hash == F.xxhash64(docs.text))


def _keys(decided: DataFrame) -> DataFrame:
    return decided.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).distinct()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; a missing lang is filled with the predicted one."""
    found = langid.identified(docs).filter("NOT rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id. A row repeated with its words stays once."""
    docs = docs.select(*COLUMNS)
    kept = stored(minhash.groups(docs).filter("kept"), "kept")
    once = docs.join(_keys(kept.filter("n_shingles > 0 AND doc_id IS NOT NULL")), [F.col("key_id") == docs.doc_id, F.col("key_hash") == F.xxhash64(docs.text)], "left_semi")
    keys = _keys(kept.filter("n_shingles = 0 OR doc_id IS NULL"))
    rest = docs.join(keys, _same_row(keys, docs), "left_semi")
    return once.withColumn("mark", F.xxhash64("text")).dropDuplicates(["doc_id", "mark"]).drop("mark").unionByName(rest)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long sequences that a document of smaller id has as well; the others stay as they are."""
    found = substrings.without_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    docs = docs.select(*COLUMNS)
    keys = _keys(decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).filter("contaminated"))
    return docs.join(keys, _same_row(keys, docs), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, with their token ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


def _bounded(stage):
    """A stage whose kernels get the texts in small batches, also when its result is written later."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _bounded(stage)) for name, stage in (
    ("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontamination), ("packing", pack))]
#: Compression and tokenization are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
