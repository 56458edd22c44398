"""Session defaults, and where intermediate results may be written."""

from __future__ import annotations

import atexit
import tempfile
from contextlib import suppress

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_REMOVED_AT_EXIT: set[str] = set()

# What the operators count on; a cluster sets sizes (partitions, memory, checkpoint folder) itself.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Otherwise every column call walks the Python stack for the sake of error messages.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "tutorspark", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tutorspark-"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which executors can reach.

    It is removed when the driver ends.  The library itself writes nothing there; queries that
    write and read back name it as their target.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        # One machine, as in tests: its own folder is shared by all that runs on it.
        base = tempfile.mkdtemp(prefix="tutorspark-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/tutorspark-{spark.sparkContext.applicationId}-written"
    if folder not in _REMOVED_AT_EXIT:
        _REMOVED_AT_EXIT.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    with suppress(Exception):  # the session may be gone; nothing else depends on it
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Keep a prepared table for several metrics, in a Parquet folder or in executor storage."""
    if path is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
