"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Without it shuffle files stay on the disk until the driver's garbage collector finds that nothing refers to their plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Of local sessions that came without a folder.
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lurewatch", folder: str | None = None) -> SparkSession:
    """A session for tests and the local benchmark. On a cluster use the session that is given.

    ``folder`` takes checkpoints and working tables; without one a new temporary folder does."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="lurewatch-"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LUREWATCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC everywhere, whatever the session came with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that tasks get from now on, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and working tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder; on a cluster an executor could not
    read it back after another executor is lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="lurewatch-")
    return _LOCAL_FOLDERS[application]


def partitions(spark: SparkSession) -> int:
    """The session's number of partitions, for exchanges whose partitions are not to be joined."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt_out(df: DataFrame) -> DataFrame:
    """The rows, dealt out over the session's partitions, for costly work on tables of few row groups."""
    return df.repartition(partitions(df.sparkSession))


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """The rows, written into the shared folder and read back from there. A table is computed once, where a checkpoint computes its
    last stage a second time for the files, and readers take only the columns that they need. The shuffle files of the write go with it. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/views/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
