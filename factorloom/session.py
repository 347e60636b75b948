"""Session helpers: a session for tests and benches, and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "factorloom") -> SparkSession:
    """A session for tests and benches; on a cluster the caller passes its own session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may go without; it gets a scratch folder.  On a cluster
    a machine-local folder would lose files, so a missing setting is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Smaller than a checkpoint (columnar, compressed), and a lost executor costs no recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
