"""Folders that all executors share, and tables kept there between jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    """A folder of this process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this process where that is unset in local mode, and an error on a cluster, whose executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


def scratch(spark: SparkSession, kind: str = "stream") -> str:
    """The name of a new folder there."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame, kind: str = "kept") -> DataFrame:
    """Writes the table to a new folder and reads it back: lineage ends here, and losing an executor loses nothing."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str):
    """(file system, path) of a name, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if there is no such folder."""
    fs, top = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = folder(spark, path)
    fs.delete(p, True)


def written_bytes(spark: SparkSession, path: str) -> int:
    fs, p = folder(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file as a whole: a reader finds all of it or nothing."""
    fs, target = folder(spark, path)
    draft = folder(spark, f"{path}.{uuid.uuid4().hex}.draft")[1]
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = folder(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
