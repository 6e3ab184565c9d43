"""Session helpers: settings for local runs and the shared folder for frozen tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, app: str = "swayrank") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's settings apply instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it, if it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder frozen tables go to: `spark.checkpoint.dir`, or a scratch one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="swayrank-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_scopes: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Frozen tables made inside go to one folder, which is deleted at the end; write results that read them before that.

        with scratch(spark):
            run_grid(...).write.parquet(path)
    """
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freeze(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write `df` to the shared folder once and go on from the written table.

    Used where a value depends on how rows happened to be partitioned, and where several later jobs
    read the same rows. After this, losing an executor rereads the table instead of computing it
    again; readers get pruned columns, and joins see its true size.

    With `spread`, a table too small to occupy all cores is dealt out to them: its rows are about to
    be multiplied (by runs, trees or background rows). Larger tables are read as they are.
    """
    spark = df.sparkSession
    path = f"{_scopes[-1] if _scopes else shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table
