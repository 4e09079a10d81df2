"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .sources.folders import drop

#: How large tables that stay, or that carry whole texts, are compressed.
DENSE = {"compression": "zstd"}


#: Whether Spark lets the shuffle files of a query go when that is done; else they stay until the driver's garbage is collected.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written in the block leaves no shuffle files behind; each write plans its own, so none is missed later."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a folder of
    its own; executors of a cluster would each write to their own disk there, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/evispark/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: what is used several times is computed once, and lineage ends here."""
    path = new_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def lent(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Write and read again for as long as the block lasts; what is made of the table is written by then, and the table goes."""
    path = new_path(df.sparkSession, name)
    try:
        with swept(df.sparkSession):
            df.write.options(**DENSE).parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        drop(df.sparkSession, path)


def dealt(df: DataFrame) -> DataFrame:
    """A table that was just read, dealt to all cores if its files give less than half of them a task.

    Small files with one row group are read by one task, however much work follows. A table with enough tasks, as any
    large one, is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
