"""Intermediate results as Parquet in the folder that driver and executors share (``spark.checkpoint.dir``).

A staged table has no lineage, so a lost executor costs no recomputation, and its size is known to the planner. Paths are
deleted when the application ends, or earlier by :func:`release`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The paths made by this driver that are still there, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loomline-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/loomline-{label}-{uuid.uuid4().hex}"
    store, where = _path(spark, path)
    store.deleteOnExit(where)
    _made.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns what was written."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_made)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes what was made since ``mark()`` gave ``since``, but for the last ``keep`` paths; no frame may still read it."""
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for path in gone:
        store, where = _path(spark, path)
        store.delete(where, True)
