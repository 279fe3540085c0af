"""Chat formatting: logged snapshots of a growing conversation are collapsed to the longest, then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SEEDS = ("a", "b")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, role, text, p1, p2): turns of a conversation numbered from 1 in the order of turn, role and
    text, nulls first, with the rolling hash of all turns up to each.

    Exactly repeated rows count once. The hash of a prefix is the exclusive-or of its turns' hashes, each taken
    over position, role and text (null and empty differ), so it grows by one step per turn. Rows without a
    conv_id belong to no conversation, so each different one stands for itself under a null id."""
    own = F.struct("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # A null id gets a key of its own row, so that such rows neither meet nor gather in one task.
    rows = rows.withColumn("conv", F.when(F.col("conv_id").isNull(), F.concat(F.lit("?"), F.sha2(F.to_json(own, {"ignoreNullFields": "false"}), 256)))
                           .otherwise(F.col("conv_id").cast("string")))
    once = rows.repartition("conv").dropDuplicates(["conv", "turn", "role", "text"])
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    said = F.struct("n", F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text")
    out = once.withColumn("n", F.row_number().over(order))
    for k, seed in enumerate(SEEDS, 1):
        out = out.withColumn(f"p{k}", F.bit_xor(F.xxhash64(F.lit(seed), said)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("conv", "conv_id", "n", "role", "text", "p1", "p2")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, n_turns): conversations that are no proper prefix of another; of equal ones that of the smallest id.

    Prefixes are made distinct before they meet the conversations, so a first turn that most conversations share is one row."""
    steps = numbered(turns)
    whole = steps.groupBy("conv").agg(F.max_by(F.struct("conv_id", F.col("n").alias("n_turns"), "p1", "p2"), "n").alias("w")).select("conv", "w.*")
    first = whole.groupBy("n_turns", "p1", "p2").agg(F.min_by(F.struct("conv", "conv_id"), F.struct(F.col("conv_id").isNull(), "conv_id", "conv")).alias("c"))
    proper = steps.join(whole.select("conv", "n_turns"), "conv").filter("n < n_turns").select(F.col("n").alias("n_turns"), "p1", "p2").distinct()
    return first.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("c.conv", "c.conv_id", "n_turns")


def render(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, rendered): each maximal conversation as one text, turn after turn as
    begin + role + newline + text + end + newline; null roles and texts are written as empty."""
    kept = maximal(turns).select("conv", "n_turns")
    line = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n"))
    rows = numbered(turns).join(kept, "conv").select("conv", "conv_id", "n_turns", F.struct("n", line.alias("line")).alias("turn"))
    return rows.groupBy("conv", "conv_id", "n_turns").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["line"]), "").alias("rendered")).drop("conv")
