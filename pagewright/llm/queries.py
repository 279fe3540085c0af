"""Registered queries of the corpus operators over the whole given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import (
    bytebpe, chat, decontaminate, embeddedup, langid, maintext, minhash, ngramlm, packing, resample, substrings, tokenbin, vectorcodes)
from pagewright.llm.common import read
from pagewright.llm.oracles import ORACLES  # noqa: F401  (the twins are registered with the queries)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identified(docs).select(
        "doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(read(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scores(read(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenbin.write_files(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return tokenbin.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(read(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    found = bytebpe.decode(bytebpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_decontamination, op3_minhash_dedup, op4_embedding_dedup, op5_lm_scoring, op6_chat_formatting, op7_token_binary, op8_packing, op9_html_extraction,
                                  op10_substring_dedup, op11_byte_bpe, op12_importance_resampling, op13_vector_codes)}
