"""Reading pages, rules and snapshots; writing results, bodies and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions.mime import is_text_mime, mime_base

SNAPSHOT_VERSION = 1
SNAPSHOT_FIELDS = (
    "version int, cookies_json string, storage map<string,map<string,string>>, "
    "history array<struct<url:string,title:string,status:int>>, history_index bigint")
RESULTS_PER_FILE = 100_000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page corpus (page_id, url, html); only the columns a query uses are read."""
    return spark.read.parquet(path)


def rules_df(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A configuration table. It is driver-side data by nature; as an Arrow table it becomes a local relation, so
    its size is known when Spark plans a join with it and it is broadcast only if it is small."""
    table = spark.createDataFrame(rows, schema)
    return spark.createDataFrame(table.toArrow(), table.schema)


def write_binaries(responses: DataFrame, path: str) -> DataFrame:
    """Save the non-text bodies of `responses(page_id, url, content_type, body)` and return their
    notes (page_id, markdown)."""
    bodies = responses.filter(~is_text_mime(mime_base("content_type")))
    bodies.select("page_id", "url", "content_type", "body").write.mode("overwrite").parquet(path)
    mime = mime_base("content_type", "application/octet-stream")
    return bodies.select("page_id", F.format_string("[Downloaded %s, %d bytes to %s]", mime, F.octet_length("body"), F.lit(path))
                         .alias("markdown"))


def write_results(results: DataFrame, path: str, per_file: int = RESULTS_PER_FILE) -> None:
    """Result envelopes as JSON lines in files of bounded length."""
    results.select(F.col("json").alias("value")).write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def _key(key: bytes) -> Column:
    return F.unhex(F.lit(key.hex()))


def encrypt_snapshots(snapshots: DataFrame, key: bytes) -> DataFrame:
    """(session, content): 12-byte nonce, then AES-256-GCM ciphertext of the JSON snapshot."""
    text = F.to_json(F.struct(F.lit(SNAPSHOT_VERSION).alias("version"), "cookies_json", "storage", "history", "history_index"))
    return snapshots.select("session", F.aes_encrypt(text.cast("binary"), _key(key), F.lit("GCM")).alias("content"))


def write_snapshots(snapshots: DataFrame, path: str, key: bytes) -> None:
    encrypt_snapshots(snapshots, key).write.mode("overwrite").parquet(path)


def decrypt_snapshots(content: DataFrame, key: bytes) -> DataFrame:
    """Snapshots that can be read: wrong keys, damaged or short content, bad JSON and newer versions
    are skipped."""
    plain = F.try_aes_decrypt(F.col("content"), _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary")).cast("string")
    parsed = content.filter(F.octet_length("content") >= 28).withColumn("_s", F.from_json(plain, SNAPSHOT_FIELDS))
    return parsed.filter(F.col("_s.version") <= SNAPSHOT_VERSION).drop("content").select("*", "_s.*").drop("_s", "version")


def read_snapshots(spark: SparkSession, path: str, key: bytes, raw_files: bool = False) -> DataFrame:
    """Snapshots of a table written by `write_snapshots`, or with `raw_files` of one file each
    (`session` is then the file path)."""
    if raw_files:
        content = spark.read.format("binaryFile").load(path).select(F.col("path").alias("session"), "content")
    else:
        content = spark.read.parquet(path)
    return decrypt_snapshots(content, key)


def create_views(**frames: DataFrame) -> None:
    """Name frames for SQL, for example create_views(page=results, links=links, cookies=jar)."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
