"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "lexiloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEXILOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder path of the cluster's shared folder, ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a single-process master (tests, a laptop) gets a
    temporary folder; on a cluster that is an error, because no other machine would see such a folder.
    """
    return f"{_application_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def _application_folder(spark: SparkSession) -> str:
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
        base = _local_folder()
    return f"{base.rstrip('/')}/lexiloom-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete everything that this application has stored in the shared folder. Results that read it become void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lexiloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a costly result with several readers: it is computed once, its lineage ends there, and a lost executor
    costs a read.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
