"""Paths: scratch folders that all workers share, and what a path holds."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
#: Whether shuffle files go when their query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            root = set_dir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "/tmp/panelforge-checkpoints"
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _clean(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; what stays is scratch
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder, which is removed when the driver exits."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{scratch_root(spark)}/panelforge-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _scratch[app])
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex[:12]}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new scratch path, as small as may be, and read from there; what its plan shuffled is removed at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, by the file system that Spark reads it with."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
