"""Small files and folder listings on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset, a folder beside the warehouse, if all processes share this machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_spindrift"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, where = _at(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str, errors: str = "replace") -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors=errors)
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Writes a small file; where it stands already, it is an error unless overwrite is set."""
    system, where = _at(spark, path)
    stream = system.create(where, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole under a name that nobody has taken; False where somebody has.

    The text is written aside first and takes the name in one step (a link on a local disk, a rename elsewhere), so readers never see
    a part of it and of two writers one wins.  The file system must refuse to rename onto a file that is there, as HDFS does.
    """
    aside = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    system, source = _at(spark, aside)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if system.getScheme() != "file":
            return not system.exists(target) and system.rename(source, target)
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            spark._jvm.java.nio.file.Files.createLink(local(target), local(source))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        system.delete(source, False)


def ages(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder, and the seconds since each was last changed."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return {}
    now = time.time()
    return {x.getPath().getName(): now - x.getModificationTime() / 1000 for x in system.listStatus(where)}


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def scratch(spark: SparkSession, path: str) -> str:
    """A folder that goes when the driver's Python ends."""
    _scratch.append((spark, path))
    return path


def kept(frame: DataFrame) -> DataFrame:
    """A frame written once to the shared folder: what is built on it does not compute it again.  Deleted when the driver's Python ends."""
    spark = frame.sparkSession
    to = scratch(spark, f"{shared_folder(spark)}/spindrift-kept-{uuid.uuid4().hex}")
    frame.write.parquet(to)
    return spark.read.schema(frame.schema).parquet(to)


def _clean() -> None:
    while _scratch:
        try:
            delete(*_scratch.pop())
        except Exception:  # the session is gone
            return


atexit.register(_clean)
