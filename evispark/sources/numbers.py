"""Numbers in order of arrival: within a table, and over many appends to one place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch
from .folders import create, drop, found


def counted_in_order(df: DataFrame, name: str = "seq") -> tuple[DataFrame, int]:
    """``df`` with ``name``, numbers from 0 on without gaps in the order in which the rows stand, and how many rows there are.

    Each task numbers its rows as they are written aside; from the tasks' counts, which are a small table, follow the numbers
    that they begin with. Rows are neither sorted nor brought together.
    """
    return number(scratch(arrivals(df), "arrivals"), name)


def arrivals(df: DataFrame) -> DataFrame:
    """``df`` with _n, task << 33 and on from there, for number() once it is written."""
    return df.withColumn("_n", F.monotonically_increasing_id())


def number(written: DataFrame, name: str) -> tuple[DataFrame, int]:
    """What counted_in_order gives, of written arrivals."""
    task, at = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    begins, size = [], 0
    for r in written.groupBy(task.alias("_task")).agg(F.count("*").alias("_size")).orderBy("_task").collect():  # a row for each task
        begins.append((r["_task"], size))
        size += r["_size"]
    table = written.sparkSession.createDataFrame(pa.table(list(zip(*begins)) or [[], []], pa.schema([("_task", pa.int64()), ("_begin", pa.int64())])))  # no Python worker reads it
    return written.withColumn("_task", task).join(table, "_task").withColumn(name, F.col("_begin") + at).drop("_task", "_begin", "_n"), size


class Numbers:
    """Blocks of numbers from 0 on, each given away once; what has been given is the name of an empty file under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def following(self) -> int:
        """The next number that no one has."""
        return self._last()[1]

    def _last(self) -> tuple[str | None, int]:
        last = max(found(self.spark, f"{self.path}/next-*"), key=lambda p: p.rsplit("-", 1)[1], default=None)
        return last, int(last.rsplit("-", 1)[1]) if last else 0

    def reserve(self, n: int) -> int:
        """The first of n numbers that are the caller's from now on, whether it uses them or not."""
        while n:
            last, first = self._last()
            if create(self.spark, f"{self.path}/next-{first + n:020d}"):  # nobody else was quicker
                if last:
                    drop(self.spark, last)
                return first
        return self.following()
