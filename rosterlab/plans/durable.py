"""Cutting a plan so that later stages read stored rows instead of recomputing them.

The rows go to reliable storage as Parquet, so the loss of an executor never loses them and later
stages read only the columns they use. The folder is the one the cluster names in
``spark.checkpoint.dir``. Results read these rows until they are written themselves, so only who asked for
them knows when they can go: ``scratch`` deletes what was stored inside it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints. Only a local session without a setting gets a temporary one."""
    context = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rosterlab-"))
    return context.getCheckpointDir()


_open_scopes: list[list[str]] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for made in _open_scopes:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the folders that were made inside: results have to be written by then."""
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        # Not remove(), which would take another scope with equal paths.
        _open_scopes[:] = [scope for scope in _open_scopes if scope is not made]
        settings = spark._jsc.hadoopConfiguration()
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(settings).delete(path, True)


def freeze(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark, "frozen")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freeze_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Stored rows and their number, counted while they are written."""
    seen = Observation()
    return freeze(df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen.get["rows"]
