"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset, a folder beside the warehouse."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_spindrift"


def keep(frame: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage ends there, and a lost executor costs none of it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/spindrift/{what}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(frame.schema).parquet(path)
    out._kept_at = path
    return out


def discard(frame: DataFrame) -> None:
    """Deletes a table that keep() wrote and that no later one is read from."""
    path = getattr(frame, "_kept_at", None)
    if path is not None and (frame.sparkSession, path) in _written:
        _written.remove((frame.sparkSession, path))
        _delete(frame.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Deletes the tables that keep() wrote; runs when the driver's Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and its folder with it
            return


atexit.register(release)
