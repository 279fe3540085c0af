"""Command logs as DataFrames: batch scan, stream of finished files, and stream of growing files."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, line): every line of every file, one log per file, lines numbered from 1.

    A large file is read in many splits. Rows are numbered within their split, and a window over
    the split sizes (one row per split) gives each split its first line number.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    splits = lines.groupBy("log", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("log").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(bases, ["log", "_block"]).select(
        "log", (F.col("_base") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def stream_commands(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """New log files of a folder as a stream of (log, file, line_no, line).

    The unit is a new, complete file (bounded by the writer's rotation), read whole so that its
    lines keep their numbers. All files of a folder form one log.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(
        F.lit(folder).alias("log"), F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "line"))


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


class _Tail(DataSourceStreamReader):
    """Offsets are {file: bytes of complete lines}. A batch is what was appended to each file, up to its last line break."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.disk, self.folder = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.part_bytes = int(options.get("partBytes", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files = self.disk.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return {f.path: self._complete(f.path, f.size) for f in files if f.is_file and not f.base_name.startswith((".", "_"))}

    def _complete(self, path: str, size: int) -> int:
        """Bytes up to the last line break, looked for from the end."""
        with self.disk.open_input_file(path) as file:
            stop = size
            while stop > 0:
                start = max(0, stop - 65536)
                at = file.read_at(stop - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(path, at, min(at + self.part_bytes, stop)) for path, stop in sorted(end.items())
                for at in range(start.get(path, 0), stop, self.part_bytes)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """Lines that begin in the range, read to their ends. A range that begins within a line leaves it to the one before."""
        with io.BufferedReader(self.disk.open_input_file(partition.file)) as file:
            at = partition.start
            if at:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < partition.stop:
                line = file.readline()
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """`spark.readStream.format("log_tail").load(folder)`: see `tail_commands`."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, line_no bigint, line string"

    def streamReader(self, schema) -> _Tail:
        return _Tail(self.options)


def tail_commands(spark: SparkSession, folder: str, part_bytes: int = 32 << 20) -> DataFrame:
    """Lines appended to the files of a folder as a stream of (log, file, line_no, line).

    Only complete lines are served, each once; a line that is still being written waits for its end. `line_no` is the
    byte at which a line begins: it orders the lines of a file without reading what was served before. Files only
    grow; large additions are read in parts of `part_bytes`, and the driver only looks for the last line break."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("log_tail").option("partBytes", part_bytes).load(folder)
    return lines.select(F.lit(folder).alias("log"), "file", "line_no", "line")
