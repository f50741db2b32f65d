"""Intermediate results that several plans read, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_local: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    A session in local mode that names none gets a temporary one, which ends with the
    process; the session's settings are left alone. On a cluster the setting is required,
    since executors do not see each other's disks.
    """
    global _local
    folder = spark.conf.get(_FOLDER, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {_FOLDER} to a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="tidegate-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return _local


def write_shared(df: DataFrame, name: str, codec: str = "snappy") -> str:
    """Write a frame below the shared folder; the path goes when the session's JVM ends or by ``drop_shared``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    file_system, place = on_file_system(spark, path)
    file_system.deleteOnExit(place)
    return path


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """The rows of a stored table dealt out evenly, for work that costs much per row and little per byte.

    Spark cuts its reading by bytes and never within a row group, so a file of a million narrow rows is one task.
    The rows are counted in the files' footers.
    """
    return df.repartition(max(1, -(-df.count() // rows_per_task)))


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage so that executors can be lost, and lets later readers prune
    columns and push filters.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name, codec))


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove a table that ``write_shared`` made and that no plan reads any more."""
    file_system, place = on_file_system(spark, path)
    file_system.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder if it is not there."""
    file_system, place = on_file_system(spark, path)
    file_system.mkdirs(place)


def on_file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
