"""The folder that the cluster shares: cutting lineage in loops, and tables of one job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs in one process (tests)."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        place = tempfile.mkdtemp(prefix="wavelake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The path as Spark's file systems see it, and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = file_system(spark, path)
    return store.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    place, store = file_system(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Renames a staged file or folder to target unless that is there; whether it did. One of several at a time wins where
    the store's rename without overwriting is atomic, as in HDFS."""
    jvm = spark.sparkContext._jvm
    (source, store), (place, _) = file_system(spark, staged), file_system(spark, target)
    store.mkdirs(place.getParent())
    if store.exists(place):
        return False
    qualified = [store.makeQualified(p) for p in (source, place)]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(*qualified, options)
    except Exception as error:  # a Java exception, seen through the gateway
        if store.exists(place):
            return False
        raise error
    return True
