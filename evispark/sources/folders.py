"""Names under a folder that the driver and all executors share, by the file system that its path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern such as ``folder/*/part-*``, in order; none if the folder isn't there."""
    p, fs = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, files: list[str]) -> int:
    """Bytes of files, as ``DataFrame.inputFiles`` names them."""
    total = 0
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return total


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file, if there is none; whether there was none."""
    p, fs = _at(spark, path)
    return bool(fs.createNewFile(p))
