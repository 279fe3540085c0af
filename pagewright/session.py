"""Session construction and reliable intermediate storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "pagewright", **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster `master` is normally left to spark-submit; `conf` entries win over these.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Plans here have many columns; recording a call site for each costs more than planning them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # A single small file is cut into a split per core before the Python kernels; large ones keep their size.
        "spark.sql.files.openCostInBytes": "65536",
        # HTML rows are wide: few rows per Arrow batch keep worker memory flat.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may do without: its executors share the machine, so a temporary folder is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagewright-ckpt-"))
    return spark.conf.get("spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """A table that several branches of a plan read, computed once and kept in the shared
    checkpoint folder, so that it outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared checkpoint folder and read again: computed once, where a checkpoint computes it twice."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
