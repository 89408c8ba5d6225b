"""Intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session has none, local mode gets a temporary folder; on a cluster
    that is an error, for executors would write to disks of their own.
    """
    context = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not have:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        have = tempfile.mkdtemp(prefix="lodestar-shared-")
        context.setCheckpointDir(have)
    return have.rstrip("/")


#: Of each application, what it wrote.
_WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, noted for :func:`release` and deleted when the application ends."""
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder; results that still read it must be written before."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in written:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    return len(written)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: later stages re-read files instead of recomputing, and a lost
    executor costs no more than a re-read.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
