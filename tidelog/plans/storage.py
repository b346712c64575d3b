"""Where intermediate tables go, and how a plan's lineage is cut.

A cut is a Parquet table in the folder all executors share (``spark.checkpoint.dir``): unlike a cached or locally
checkpointed plan it survives the loss of any executor, and it is written once and read with column pruning.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (local tests) a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_tidelog_dir"):
        context._tidelog_dir = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return context._tidelog_dir


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application; ``sweep`` removes it."""
    return f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read from there."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes every cut of this application. Results that still read from one must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidelog_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it runs from such an archive already
        archive = f"{tempfile.mkdtemp(prefix='tidelog-')}/tidelog.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for at, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(package)))
        context.addPyFile(archive)
    context._tidelog_shipped = True
