"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "gridsignal") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process. ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only on a local master, as in tests, one is made where the session names none. On a cluster that is an error: its
    machines would write to their own disks and read incomplete tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = tempfile.mkdtemp(prefix="gridsignal-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which can be removed when the application ends."""
    return os.path.join(shared_dir(spark), f"gridsignal-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
