"""A table of batches: each version is a folder that Spark writes, with schema enforcement and reads as of a version."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COMMIT, parsed
from ..scratch import DENSE, scratch, swept
from .folders import drop, found


class SchemaEnforcementError(ValueError):
    """A batch whose columns are not the table's."""


#: Quantiles are off by at most one in so many rows.
ACCURACY = 100_000


class VersionedTable:
    """Batches under ``path``: rows in ``rows/<generation>/<version>``, and for each a row in ``log/<generation>/<version>,<operation>,<batch>``.

    Rows are written first; a version is there once its log row is, and one that failed is written anew to the same folder. An
    overwrite is a new generation with versions from 0: until it is there the old one stays, then that goes. Rows are counted by the
    write itself. One writer at a time; for several use a table format of the cluster. ``clock`` gives timestamps, so that jobs
    can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, check_types: bool = False, clock=lambda: datetime.now(UTC).isoformat()):
        self.spark, self.path, self.check_types, self.clock = spark, path.rstrip("/"), check_types, clock

    def _committed(self) -> tuple[int, dict[int, str]]:
        """The newest generation that has versions, or -1, and the names of those; from the names of folders alone."""
        by_generation: dict[int, dict[int, str]] = {}
        for p in found(self.spark, f"{self.path}/log/*/*/part-*"):
            generation, name = p.split("/")[-3:-1]
            by_generation.setdefault(int(generation), {})[int(name.split(",")[0])] = name
        newest = max(by_generation, default=-1)
        return newest, by_generation.get(newest, {})

    def _log(self, generation: int, name: str = "*") -> DataFrame:
        return self.spark.read.schema(parsed(COMMIT)).json(f"{self.path}/log/{generation:08d}/{name}")

    def versions(self) -> list[int]:
        return sorted(self._committed()[1])

    def schema(self) -> T.StructType | None:
        generation, names = self._committed()
        return self._schema(generation, names) if names else None

    def _schema(self, generation: int, names: dict[int, str]) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._log(generation, names[max(names)]).first()["schema"]))

    def check_schema(self, df: DataFrame) -> None:
        """Raise if the set of column names differs from the table's (with ``check_types``, the types as well)."""
        blueprint = self.schema()
        if blueprint is not None:
            self._compare(blueprint, df)

    def _compare(self, blueprint: T.StructType, df: DataFrame) -> None:
        old, new = {f.name: f.dataType.simpleString() for f in blueprint}, dict(df.dtypes)
        extra, missing = sorted(new.keys() - old.keys()), sorted(old.keys() - new.keys())
        if extra or missing:
            raise SchemaEnforcementError(f"extra columns {extra}, missing columns {missing}")
        retyped = sorted(n for n in old if self.check_types and old[n] != new[n])
        if retyped:
            raise SchemaEnforcementError(f"other types for {retyped}")

    def version_of(self, operation: str, batch_id: str) -> int | None:
        """The version that a batch was committed as, if it was; no row is read."""
        label = _label(operation, batch_id)
        return next((v for v, name in self._committed()[1].items() if name.partition(",")[2] == label), None)

    def write(self, df: DataFrame, mode: str = "append", operation: str = "WRITE", batch_id: str | None = None) -> int:
        """Commit the rows and give the version; no rows are a version too. ``overwrite`` starts again with version 0, and what was
        there goes once its rows are written.

        With ``batch_id`` a batch that is already there is not written again; its version is given.
        """
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode {mode!r}")
        if batch_id is not None and (done := self.version_of(operation, batch_id)) is not None:
            return done
        generation, names = self._committed()
        schema = df.schema
        if mode == "append" and names:
            schema = self._schema(generation, names)
            self._compare(schema, df)
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
        version = max(names) + 1 if mode == "append" and names else 0
        old, generation = generation, generation if mode == "append" and names else generation + 1
        counted = Observation()
        with swept(self.spark):
            df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(**DENSE).parquet(f"{self.path}/rows/{generation:08d}/{version:08d}")
        row = (version, self.clock(), operation, batch_id, mode, counted.get["n"], schema.json())
        log = self.spark.createDataFrame([row], parsed(COMMIT)).coalesce(1).write.mode("overwrite")
        log.json(f"{self.path}/log/{generation:08d}/{version:08d},{_label(operation, batch_id)}")
        if 0 <= old < generation:
            for kind in ("log", "rows"):
                drop(self.spark, f"{self.path}/{kind}/{old:08d}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of all batches up to ``version`` (the latest by default); an empty table has no columns and rows."""
        generation, names = self._committed()
        if version is not None and version not in names:
            raise ValueError(f"no version {version}; there are {sorted(names)}")
        if not names:
            return self.spark.createDataFrame([], T.StructType([]))
        folders = [f"{self.path}/rows/{generation:08d}/{v:08d}" for v in sorted(names) if version is None or v <= version]
        return self.spark.read.schema(self._schema(generation, names)).parquet(*folders)

    def history(self) -> DataFrame:
        """(version, timestamp, operation, numRecords, mode) in order of versions, from the log alone."""
        generation, names = self._committed()
        rows = self._log(generation) if names else self.spark.createDataFrame([], parsed(COMMIT))
        return rows.select("version", "timestamp", "operation", "numRecords", "mode").orderBy("version")


def _label(operation: str, batch_id: str | None) -> str:
    return f"{quote(operation, safe='')},{quote(batch_id or '', safe='')}"


def normalise_for_commit(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numeric columns as double, null where a value is no number; text columns as string; the others as they are."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(c.try_cast("double").alias(name) if name in numeric else c.cast("string").alias(name) if kind in ("string", "void") else c)
    return df.select(*out)


def incremental_load(df: DataFrame, table: VersionedTable, order: str, ratio: float = 0.75) -> list[int]:
    """Commit the first ``ratio`` of the rows by ``order`` (one at least), then the rest if there is one; the versions.

    The cut is found by quantiles of ``order`` and counts, not by a global sort; these read that column alone, twice if the
    first quantile is close enough. Of the rows that share the value at the cut some come first: they are numbered as they
    are written aside, and the number at the cut follows from their counts by task. ``order`` is numeric and without nulls.
    """
    value = F.col(order)
    count, nulls, guess = df.agg(F.count("*"), F.count_if(value.isNull()), F.percentile_approx(order, ratio, ACCURACY)).first()
    if not count:
        return [table.write(df, "overwrite", "INITIAL_LOAD")]
    if nulls:
        raise ValueError(f"{order} has nulls")
    first = max(1, int(count * ratio))
    at, below = _cut(df, order, first, count, guess)
    head, tail = df.filter(value < F.lit(at)), df.filter(value >= F.lit(at))
    if below < first:  # some or all of the rows that share the value
        tied = scratch(df.filter(value == F.lit(at)).withColumn("_n", F.monotonically_increasing_id()), "tied")
        cut = _number_at(tied, first - below)
        head = head.unionByName(tied.filter(F.col("_n") < cut).drop("_n"))
        tail = df.filter(value > F.lit(at)).unionByName(tied.filter(F.col("_n") >= cut).drop("_n"))
    versions = [table.write(head, "overwrite", "INITIAL_LOAD")]
    return versions + ([table.write(tail, "append", "INCREMENTAL_DELTA")] if count > first else [])


def _number_at(numbered: DataFrame, take: int) -> int:
    """The number under which ``take`` rows stand; numbers count on from task << 33 within each task."""
    tasks = numbered.groupBy(F.shiftright("_n", 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task")
    for r in tasks.toLocalIterator():  # a row for each task
        if take < r["n"]:
            return (r["task"] << 33) + take
        take -= r["n"]
    return 1 << 62


def _cut(df: DataFrame, order: str, place: int, count: int, guess: object) -> tuple[object, int]:
    """A value, and how many rows are below it: ``place``, or fewer, but not without those that have the value.

    Guesses are approximate quantiles of an ever smaller range, each checked by exact counts.
    """
    value, inside = F.col(order), df
    under, upto = 0, count  # rows below the range, and below its end
    while True:
        below, equal = df.agg(F.count_if(value < F.lit(guess)), F.count_if(value == F.lit(guess))).first()
        if below <= place <= below + equal:
            return guess, below
        if place < below:
            inside, upto = inside.filter(value < F.lit(guess)), below
        else:
            inside, under = inside.filter(value > F.lit(guess)), below + equal
        guess = inside.agg(F.percentile_approx(order, (place - under) / (upto - under), ACCURACY)).first()[0]
