"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that any folder is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only a local session, as in tests, may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="batida-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, where = file_system(spark, path)
        fs.delete(where, True)
    except Exception:  # the session has ended already; nothing depends on the files
        return


def new_path(spark: SparkSession, name: str = "batida") -> str:
    """A path of its own in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts lineage; the rows outlive any executor. The files go when the driver
    ends, or once a table that is written instead of this one is there.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._batida_path = path
    if instead_of is not None:
        remove(spark, instead_of._batida_path)
    return out
