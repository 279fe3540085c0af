"""Stateless page streams, the exactly-once result sink and periodic state snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.dom import html_nodes
from pagewright.operators.markdown import html_markdown
from pagewright.operators.secrets import redact_pages


def stream_pages(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Page files (page_id, url, html) of a folder as a stream."""
    reader = spark.readStream.schema("page_id bigint, url string, html string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_nodes(pages: DataFrame, **options) -> DataFrame:
    return html_nodes(pages, **options)


def start_page_sink(pages: DataFrame, convert: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Arriving pages through a batch operator, such as `html_markdown`, micro-batch by micro-batch.

    A batch owns the folder `path/batch=<id>`, so a retried one overwrites only what it wrote itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redacted_markdown(pages: DataFrame, patterns=None, **options) -> DataFrame:
    """Redacted Markdown of pages, for batches and for `start_page_sink`."""
    return redact_pages(html_markdown(pages, **options), True, patterns)


def start_file_sink(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append to files exactly once: the sink's log and the checkpoint make a retried batch harmless."""
    return (rows.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Number -> folder of the finished `<path>/<prefix>=<number>` folders."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    disk = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in disk.listStatus(root)] if disk.exists(root) else []
    return {int(p.getName().split("=")[1]): p.toString() for p in found
            if p.getName().startswith(prefix + "=") and disk.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def _state_folders(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The newest whole state and the changes behind it."""
    bases = {n: f for n, f in _folders(spark, path, "state").items() if upto is None or n <= upto}
    newest = max(bases, default=-1)
    changes = _folders(spark, path, "changes")
    return [bases[n] for n in bases if n == newest] + [f for n, f in sorted(changes.items()) if n > newest and (upto is None or n <= upto)]


def read_state(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The latest row of every key that `start_state_snapshots` keeps under `path`."""
    return _latest(spark.read.parquet(*_state_folders(spark, path)), keys, order)


def start_state_snapshots(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, compact_every: int = 20) -> StreamingQuery:
    """Keep the latest row per key: a change log, put together now and then.

    A micro-batch writes the keys it touched to `path/changes=<batch>`, and nothing else. Every `compact_every` batches
    the newest whole state and the changes since become `path/state=<batch>`; then changes up to there and states before
    the previous one are removed, so a reader of the previous state is not disturbed. A retried batch rewrites its own
    folders from what was there before it; a state that is finished is not written again."""
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if max(_folders(spark, path, "state"), default=-1) >= batch_id:
            return
        _latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/changes={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = spark.read.parquet(*_state_folders(spark, path, batch_id))
            _latest(whole, keys, order).write.mode("overwrite").parquet(f"{path}/state={batch_id}")
            states = sorted(_folders(spark, path, "state").items())
            before = states[-2][0] if len(states) > 1 else -1
            old = [f for n, f in _folders(spark, path, "changes").items() if n <= before] + [f for _, f in states[:-2]]
            _remove(spark, old)

    return (changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
