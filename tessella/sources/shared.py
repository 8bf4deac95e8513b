"""Intermediate results as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only where none is set and all tasks run in this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write `df` once and read it back: cuts lineage, and outlives lost executors. Then delete the tables `done`, as `dropped` does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    dropped(*done)
    return back


def settled(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """As `written`; Spark deletes the shuffles behind the table as soon as it is written, not when the driver collects garbage."""
    spark = df.sparkSession
    now = spark.conf.get(_CLEANUP_SETTING)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        return written(df, name, *done)
    finally:
        spark.conf.set(_CLEANUP_SETTING, now)


def kept_until_end(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose contents are deleted when the application ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that no frame still to be computed reads; frames that it didn't make stay as they are."""
    for table in tables:
        path = table.__dict__.get("written_to")
        if path in _made:
            _delete(path)


def _delete(path: str) -> None:
    context = _made.pop(path).sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def forget() -> None:
    """Delete what `written` has left; only for the end of an application, when no frame reads it any more."""
    for path in list(_made):
        try:
            _delete(path)
        except Exception as e:  # noqa: BLE001  whatever a session that has ended raises
            logging.getLogger(__name__).info("not deleted: %s (%s)", path, e)


atexit.register(forget)
