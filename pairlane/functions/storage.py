"""Materialising intermediate tables where all executors can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, whose executors are threads of the driver, may go without it and gets
    a temporary folder; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pairlane-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it back: for wide rows, where
    a checkpoint would be several times larger. The table goes when the session's driver ends."""
    path = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    if path := getattr(df, "saved_path", None):
        _remove(df.sparkSession, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as the file system's own listing writes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return  # the session ended before; its folder is the cluster's to clear
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # a table that is left over costs space and no result
        warnings.warn(f"{path} was not deleted: {e}", stacklevel=2)
