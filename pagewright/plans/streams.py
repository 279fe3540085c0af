"""Registered queries that run the streaming operators: tables derived from `events` are written as files of the shared
folder, streamed from there until all is read (`availableNow`), and the sink is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.operators.commands import parse_commands
from pagewright.plans import inputs
from pagewright.session import checkpoint_dir
from pagewright.sources import logs
from pagewright.streaming import flows, state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream_of(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """The rows as files, streamed. All files make one trigger, within which the processors restore the order."""
    path = _folder(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _sunk(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = _folder(spark, name)
    flows.start_file_sink(rows, out, _folder(spark, name + "-checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream_of(spark, inputs.history_events(spark, sf).select("session", "seq", "op", "url"), "visits")
    return _sunk(spark, state.stream_history(events), "history").select("session", "seq", "cursor", "length", "code")


def stream_storage(spark: SparkSession, sf: str) -> DataFrame:
    """What every read of local storage answers in a stream."""
    events = _stream_of(spark, inputs.storage_events(spark, sf), "storage")
    rows = _sunk(spark, state.stream_storage(events), "answers")
    return rows.filter("op = 'get'").select("session", "seq", "origin", "key", "value")


def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The last write of every key, from the change log that a stream keeps."""
    keys = ["session", "origin", "key"]
    writes = inputs.storage_events(spark, sf).filter("op IN ('set', 'delete')")
    table = _folder(spark, "snapshots")
    flows.start_state_snapshots(_stream_of(spark, writes, "writes"), table, _folder(spark, "snapshots-checkpoint"), keys, "seq").awaitTermination()
    return flows.read_state(spark, table, keys, "seq").select(*keys, "seq", "op", "value")


def tailed_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines written as text files, tailed as a stream, parsed: commands by action."""
    path = _folder(spark, "logs")
    lines = inputs.command_lines(spark, sf)
    lines.repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    rows = _sunk(spark, logs.tail_commands(spark, path), "lines")
    return parse_commands(rows).groupBy("bad", "action").agg(F.count("*").alias("n"), F.countDistinct("file", "line_no").alias("places"))


def command_files(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines written as text files and read back with their numbers within the file: every file is numbered without gaps."""
    path = _folder(spark, "logs")
    inputs.command_lines(spark, sf).repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    per_file = logs.read_commands(spark, path).groupBy("log").agg(
        F.count("*").alias("n"), F.max("line_no").alias("top"), F.min("line_no").alias("low"), F.countDistinct("line_no").alias("numbers"),
        F.count(F.when(F.trim("line") != "", 1)).alias("filled"))
    dense = (F.col("n") == F.col("top")) & (F.col("n") == F.col("numbers")) & (F.col("low") == 1)
    return per_file.agg(F.sum("n").alias("lines"), F.sum("filled").alias("filled"), F.bool_and(dense).alias("dense"))


QUERIES = {f.__name__: f for f in (stream_history, stream_storage, stream_snapshots, tailed_commands, command_files)}
