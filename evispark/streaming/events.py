"""Topics of enveloped rows in order of arrival, drained once, and the quality gate on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import BatchHalted, Gate, clean_rows, grade, rejected_rows, verdict
from ..schemas import ENVELOPE, parsed
from ..scratch import DENSE, lent, swept
from ..sources.files import quarantine
from ..sources.folders import found
from ..sources.numbers import Numbers, arrivals, number
from ..sources.versions import VersionedTable

OPERATION = "STREAM_INGEST"
#: A state store on executors' disks, so that state is not held in memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def event_id(topic: str, source: str, seq: Column, digits: int = 10) -> Column:
    """``EVT_`` and the first hex digits of md5(topic, sequence number, source)."""
    return F.concat(F.lit("EVT_"), F.upper(F.substring(F.md5(F.concat(F.lit(topic), seq.cast("string"), F.lit(source))), 1, digits)))


def to_envelope(df: DataFrame, topic: str, source: str, seq: str, event_time: Column | None = None, payload: list[str] | None = None) -> DataFrame:
    """Rows as immutable events; ``seq`` counts from 0 within the topic and is its offset, the payload is the row as JSON, or the
    columns of it that are named."""
    return df.select(
        event_id(topic, source, F.col(seq)).alias("event_id"),
        (F.current_timestamp() if event_time is None else event_time).alias("event_time"),
        F.lit(topic).alias("topic"),
        F.col(seq).cast("long").alias("offset"),
        F.lit(source).alias("source_system"),
        F.to_json(F.struct(*(payload or df.columns)), {"ignoreNullFields": "false"}).alias("payload"),
    )


def from_envelope(events: DataFrame, schema: T.StructType) -> DataFrame:
    """The payloads as rows again."""
    return events.select(F.from_json("payload", schema).alias("p")).select("p.*")


def publish(events: DataFrame, path: str) -> None:
    """Append events under their topic's folder."""
    with swept(events.sparkSession):
        events.write.mode("append").options(**DENSE).partitionBy("topic").parquet(path)


def publish_rows(rows: DataFrame, path: str, topic: str, source: str, event_time: Column | None = None) -> int:
    """Publish rows as events of a topic, with offsets that go on from what it has, in the order in which they stand; the next
    offset. One publisher to a topic at a time.

    How far a topic has come is kept beside ``path``, so its events are not read.
    """
    numbers = Numbers(rows.sparkSession, f"{path.rstrip('/')}-offsets/{topic}")
    with lent(arrivals(rows), "arrivals") as written:
        held, n = number(written, "_offset")
        first = numbers.reserve(n)
        publish(to_envelope(held.withColumn("_offset", F.col("_offset") + F.lit(first)), topic, source, "_offset", event_time, rows.columns), path)
    return first + n


def topic_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("topic").agg(F.count("*").alias("published"))


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """The topic's events as a stream."""
    schema = T.StructType([f for f in parsed(ENVELOPE).fields if f.name != "topic"])
    return spark.readStream.schema(schema).parquet(f"{path}/topic={topic}").withColumn("topic", F.lit(topic))


def drain_topic(spark: SparkSession, path: str, topic: str, out: str, checkpoint: str) -> None:
    """Move everything that is buffered in a topic to ``out``, each event once however often this runs; their order is that
    of ``offset``."""
    stream = read_topic(spark, path, topic).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def _with_history(rows: DataFrame, key: str, earlier: DataFrame) -> DataFrame:
    """A stream of (_row, _key, _ever): the rows, and for each key among them how often it has come so far, as a stateful count.

    ``earlier`` is a stream of keys that count as come before. Counts are added up before they are shuffled and their
    state is one number for each key, so a batch costs what its own rows cost, however many came before.
    """
    kind = dict(rows.dtypes)[key]
    keys = rows.select(F.col(key).alias("_key")).unionByName(earlier.select("_key"))
    counted = keys.groupBy("_key").agg(F.count("*").alias("_ever")).select(F.lit(None).cast(T.StructType(rows.schema.fields)).alias("_row"), "_key", "_ever")
    return rows.select(F.struct(*rows.columns).alias("_row"), F.lit(None).cast(kind).alias("_key"), F.lit(None).cast("long").alias("_ever")).unionByName(counted)


def _gated(gate: Gate, table: VersionedTable, quarantine_path: str, label: str, order: str, threshold: float) -> Callable[[DataFrame, int], None]:
    """What a micro-batch goes through: grade, quarantine, halt or commit. Its rows are written aside once, with numbers, and
    graded as they are read."""

    def run(batch: DataFrame, batch_number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        known = f"{stream}-{batch_number}"
        with lent(batch.withColumn("_number", F.monotonically_increasing_id()), "batch") as held:  # the state moves on once, even if the batch is known
            if table.version_of(OPERATION, known) is not None:
                return
            rows, counts = held.filter("_row IS NOT NULL").select("_row.*", "_number"), held.filter("_row IS NULL").select("_key", "_ever")
            graded = grade(rows, gate, order, counts, "_number")
            row = verdict(graded, threshold).first()
            if not row["evaluated"]:
                return
            quarantine(rejected_rows(graded), label, quarantine_path, known, row["rejected"])
            if row["halt_pipeline"]:
                raise BatchHalted(f"batch {known}: {row['rejected']} of {row['evaluated']} rows are fatal")
            if row["clean"]:
                table.write(clean_rows(graded), "append", OPERATION, batch_id=known)

    return run


def ingest_stream(
    rows: DataFrame, gate: Gate, table: VersionedTable, quarantine_path: str, label: str, order: str, checkpoint: str, threshold: float = 0.30
) -> StreamingQuery:
    """Feed a stream of rows through the gate into ``table`` until what is there has been read; an error in it ends the query.

    A batch is known by its stream and its number. The stream's id belongs to its checkpoint, so a stream that goes on commits
    nothing twice, while another, or the same with a new checkpoint, commits its own. The first row of a key keeps it, wherever
    batches are cut: the stream's rows are graded as one table would be. A new stream takes the keys that ``table`` has by then for
    come before; streams that run at the same time know nothing of one another, so put their topics into one by union if they
    can share keys. A batch that halts is neither committed nor remembered. ``table`` has one writer at a time.
    """
    spark = rows.sparkSession
    seed = f"{checkpoint.rstrip('/')}-earlier"
    kind = dict(rows.dtypes)[gate.key]
    if not found(spark, f"{checkpoint}/metadata"):
        there = table.read() if table.versions() else spark.createDataFrame([], T.StructType([T.StructField(gate.key, rows.schema[gate.key].dataType)]))
        there.select(F.col(gate.key).alias("_key")).distinct().write.mode("overwrite").parquet(seed)
    earlier = spark.readStream.schema(f"_key {kind}").parquet(seed)
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():  # a query keeps what it was started with
        spark.conf.set(name, value)
    try:
        stream = _with_history(rows, gate.key, earlier).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return stream.foreachBatch(_gated(gate, table, quarantine_path, label, order, threshold)).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def unique_within(stream: DataFrame, key: str, event_time: str = "event_time", delay: str = "1 day") -> DataFrame:
    """First event of each key, with state bounded by a watermark: duplicates that come later than ``delay`` pass."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
