"""Lineage and audit: append-only JSON tables, kept apart by run."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import AUDIT, LINEAGE, parsed
from ..scratch import lent, scratch
from .folders import found
from .numbers import Numbers, arrivals, number


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Lineage:
    """Nodes ``LIN_<nnnn>_<OPERATION>`` of one run; inputs name the nodes that an operation read."""

    def __init__(self, spark: SparkSession, path: str, run_id: str | None = None, clock=_now):
        self.spark, self.path, self.clock = spark, path, clock
        self.run_id, self.count = run_id or uuid.uuid4().hex, 0

    def next_id(self, operation: str) -> str:
        """The id that the next node will have."""
        return f"LIN_{self.count:04d}_{operation}"

    def record(self, operation: str, inputs: list[str], outputs: list[str], record_count: int, details: dict | None = None) -> str:
        lineage_id = self.next_id(operation)
        row = (lineage_id, self.clock(), operation, inputs, outputs, record_count, json.dumps(details or {}, sort_keys=True), self.run_id)
        self.spark.createDataFrame([row], parsed(LINEAGE)).coalesce(1).write.mode("append").json(self.path)
        self.count += 1
        return lineage_id

    def load(self) -> DataFrame:
        return self.spark.read.schema(parsed(LINEAGE)).json(self.path)


def chain_text(nodes: DataFrame) -> DataFrame:
    """(run_id, chain): the nodes of each run in order, a block each, with arrows between them."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-"))
    parts = {"operation": F.col("operation"), "inputs": listed("inputs"), "outputs": listed("outputs"), "records": F.col("record_count").cast("string"), "at": F.col("timestamp")}
    block = F.concat(F.lit("  "), F.col("lineage_id"), *(x for name, c in parts.items() for x in (F.lit(f"\n     {name:<10}: "), F.coalesce(c, F.lit("-")))))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("lineage_id", block.alias("block")))), lambda x: x["block"])
    return nodes.groupBy("run_id").agg(F.array_join(blocks, "\n  |\n  v\n").alias("chain"))


def trace(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence rows with the outputs of the node that made them (such as ``path@v3``); Spark broadcasts the nodes if small."""
    return evidence.join(nodes.select("lineage_id", "outputs"), "lineage_id", "left")


def closure(nodes: DataFrame) -> DataFrame:
    """(run_id, lineage_id, ancestor): all nodes that each node's inputs lead to, itself included, for all nodes at once.

    Round k goes on from all that is reached by fewer than 2^k steps by exactly 2^k, so there are as many rounds as the depth
    has binary digits, and a pair is found and written once for each round that has a path to it: once in a chain.
    """
    steps = nodes.select("run_id", "lineage_id", F.explode("inputs").alias("ancestor"))
    known = nodes.select("run_id", F.col("lineage_id").alias("ancestor"))  # other inputs are names of data
    own = nodes.select("run_id", "lineage_id", F.col("lineage_id").alias("ancestor"))
    leap = scratch(steps.join(known, ["run_id", "ancestor"], "left_semi").select("run_id", "lineage_id", "ancestor").distinct(), "leap")
    reached, size, length = scratch(own.distinct(), "reached"), None, 1
    while not leap.isEmpty():
        size = size or reached.count()
        if length > size:  # a walk of as many steps as there are nodes goes round in a circle
            break
        reached = reached.union(scratch(_then(reached, leap), "reached"))
        leap, length = scratch(_then(leap, leap), "leap"), length * 2
    return reached.distinct()


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that a pair of ``first`` and one of ``second`` from its end lead to."""
    further = second.select("run_id", F.col("lineage_id").alias("ancestor"), F.col("ancestor").alias("next"))
    return first.join(further, ["run_id", "ancestor"]).select("run_id", "lineage_id", F.col("next").alias("ancestor")).distinct()


def ancestry(nodes: DataFrame, lineage_id: str, run_id: str) -> DataFrame:
    """All nodes of a run that a node's inputs lead to, itself included."""
    own = nodes.filter(F.col("run_id") == run_id)
    found = closure(own).filter(F.col("lineage_id") == lineage_id).select(F.col("ancestor").alias("lineage_id"))
    return own.join(found, "lineage_id").select(*own.columns)


def table_versions(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """``evidence`` with table_versions: outputs such as ``path@v3`` of its node and of all that lead to that, sorted. ``nodes`` are
    those of one run."""
    outputs = nodes.select(F.col("lineage_id").alias("ancestor"), F.explode("outputs").alias("output")).filter(F.col("output").rlike("@v[0-9]+$"))
    versions = closure(nodes).join(outputs, "ancestor").groupBy("lineage_id").agg(F.sort_array(F.collect_set("output")).alias("table_versions"))
    return evidence.join(versions, "lineage_id", "left")


class Audit:
    """Entries in one rising order, in folders by day. Each append reserves a block of numbers first, so none is given twice."""

    def __init__(self, spark: SparkSession, path: str, clock=_now):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.numbers = Numbers(spark, f"{self.path}-numbers")

    def load(self, days: list[str] | None = None) -> DataFrame:
        """All entries, or those of some days."""
        reader = self.spark.read.schema(parsed(AUDIT)).option("basePath", self.path)
        return reader.json([f"{self.path}/day={d}" for d in days] if days is not None else self.path).drop("day")

    def days(self) -> list[str]:
        return [p.rsplit("day=", 1)[1] for p in found(self.spark, f"{self.path}/day=*")]

    def _append(self, entries: DataFrame) -> None:
        entries.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(self.path)

    def log(self, actor: str, role: str, action: str, payload: dict) -> str:
        audit_id = f"AUD_{uuid.uuid4().hex[:12].upper()}"
        row = (audit_id, self.clock(), self.numbers.reserve(1), actor, role, action, json.dumps(payload, sort_keys=True))
        self._append(self.spark.createDataFrame([row], parsed(AUDIT)).coalesce(1))
        return audit_id

    def log_rows(self, rows: DataFrame, actor: str, role: str, action: str) -> DataFrame:
        """Append an entry for each row (payload, ...), in the order in which they stand; the rows with the seq and audit_id of theirs."""
        at = self.clock()
        name = F.concat(F.lit("AUD_"), F.upper(F.substring(F.md5(F.concat_ws("|", F.lit(action), F.lit(at), F.col("seq").cast("string"))), 1, 12)))
        with lent(arrivals(rows), "arrivals") as written:
            held, n = number(written, "seq")
            first = self.numbers.reserve(n)
            entries = scratch(held.withColumn("seq", F.col("seq") + F.lit(first)).withColumn("audit_id", name), "entries")
        who = [F.lit(v).alias(n) for n, v in (("actor", actor), ("role", role), ("action", action))]
        self._append(entries.select("audit_id", F.lit(at).alias("timestamp"), "seq", *who, "payload"))
        return entries

    def tail(self, n: int) -> DataFrame:
        """The last n entries in order; only the folders of the last days are read, as many as have n."""
        days, take = self.days(), 1
        while days:
            entries = self.load(days[-take:])
            if take >= len(days) or entries.count() >= n:
                return entries.orderBy(F.desc("seq")).limit(n).orderBy("seq")
            take *= 2
        return self.spark.createDataFrame([], parsed(AUDIT))


def tail(entries: DataFrame, n: int) -> DataFrame:
    """The last n entries by time and sequence number, in order; a top-n, not a sort of all."""
    return entries.orderBy(F.desc("timestamp"), F.desc("seq")).limit(n).orderBy("timestamp", "seq")
