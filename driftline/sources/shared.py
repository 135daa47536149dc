"""The folder that driver and executors share, for tables that outlive a lost executor."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder set by setCheckpointDir.

    Where neither is set, a local master gets a temporary folder, which goes with the process. Any other
    master is an error: executors would write to disks of their own, and later reads would miss rows.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; its maker removes it, or the folder's owner."""
    return posixpath.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder by a reliable checkpoint, its lineage cut."""
    spark = df.sparkSession
    root = shared_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
