import json
import os

import pytest
from pyspark.sql import functions as F

from evispark.functions.vectors import encode_with, hash_vectors

from evispark import queries
from evispark.jobs.workloads import Feed, Index, answer, build_index, ingest, load_governed, with_texts
from evispark.operators import quality
from evispark.operators.governance import UnknownRole
from evispark.operators.index import ChunkStore, DimensionMismatch
from evispark.operators.quality import literature_gate, trial_gate
from evispark.scratch import lent, scratch
from evispark.sources import journal
from evispark.sources.files import land_raw, quarantine, read_patients, read_quarantine
from evispark.sources.journal import Audit, Lineage, ancestry, chain_text, closure, table_versions, trace
from evispark.sources.numbers import Numbers, counted_in_order
from evispark.sources.versions import SchemaEnforcementError, VersionedTable, incremental_load, normalise_for_commit
from evispark.streaming import events as ev
from evispark.views import AS_OF, articles, patients, trials

from .conftest import SF
from .test_operators import trial, trial_frame


def test_versions(spark, tmp_path):
    lake = VersionedTable(spark, str(tmp_path / "t"), check_types=True)
    assert lake.read().count() == 0 and lake.versions() == []
    df = spark.range(4).withColumn("x", F.lit("a"))
    assert [lake.write(df), lake.write(df.select("x", "id"))] == [0, 1]
    assert lake.read(0).count() == 4 and lake.read().count() == 8
    for version in (-1, 2):
        with pytest.raises(ValueError):
            lake.read(version)
    with pytest.raises(SchemaEnforcementError, match=r"extra columns \['y'\], missing columns \['x'\]"):
        lake.write(df.withColumnRenamed("x", "y"))
    with pytest.raises(SchemaEnforcementError):
        lake.write(df.withColumn("x", F.lit(1)))
    assert [r.numRecords for r in lake.history().collect()] == [4, 4]
    assert lake.write(df, batch_id="7") == lake.write(df, batch_id="7") == 2
    assert lake.write(df.limit(1), "overwrite") == 0 and lake.read().count() == 1


def failing(spark):
    return spark.range(3).select((F.lit(1) / (F.col("id") - 1)).cast("long").alias("id"))


def test_a_failed_write_is_made_good(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        table.write(failing(spark))
    assert table.versions() == [0] and table.read().count() == 3
    assert table.write(spark.range(2)) == 1 and table.read().count() == 5


def test_a_failed_overwrite_leaves_what_was_there(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(6))
    table.write(spark.range(4))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        table.write(failing(spark), "overwrite")
    assert table.versions() == [0, 1] and table.read().count() == 10
    assert table.write(table.read().filter("id > 2"), "overwrite") == 0  # even from its own rows
    assert table.versions() == [0] and table.read().count() == 4
    assert [(r.version, r.mode, r.numRecords) for r in table.history().collect()] == [(0, "overwrite", 4)]
    assert len(list((tmp_path / "t" / "rows").iterdir())) == 1


def test_no_rows_are_a_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for empty in (spark.range(3).filter("id > 5"), spark.createDataFrame([], "id long"), spark.range(3).filter("false")):
        table.write(empty, operation="no/rows, at * all")
    assert table.versions() == [0, 1, 2] and table.read(0).count() == 0 and table.read(0).columns == ["id"]
    assert table.write(spark.range(2), operation="a/b", batch_id="x/y") == table.write(spark.range(2), operation="a/b", batch_id="x/y") == 3
    assert [(r.operation, r.numRecords) for r in table.history().collect()] == [("no/rows, at * all", 0)] * 3 + [("a/b", 2)]
    assert VersionedTable(spark, str(tmp_path / "u")).history().count() == 0


def test_history_reads_no_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(1000))
    assert not any("/rows/" in f for f in table.history().inputFiles())


def test_incremental_load_of_rows_that_all_tie(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert incremental_load(spark.range(101).select(F.lit(5).alias("k"), F.lit("same").alias("t")).repartition(7), table, "k") == [0, 1]
    assert table.read(0).count() == 75 and table.read().count() == 101


@pytest.mark.parametrize("rows", [1, 2, 4, 103])
def test_incremental_load(spark, tmp_path, rows):
    lake = VersionedTable(spark, str(tmp_path / "t"))
    df = spark.range(rows).select(((F.col("id") * 37) % 11).alias("k"), "id")
    incremental_load(df, lake, "k")
    first = lake.read(0)
    assert first.count() == max(1, int(rows * 0.75)) and lake.read().count() == rows
    rest = lake.read().exceptAll(first)
    assert rest.isEmpty() or rest.agg(F.min("k")).first()[0] >= first.agg(F.max("k")).first()[0]


def test_normalise(spark):
    df = spark.createDataFrame([("1.5", "a"), ("x", None)], "n string, t string")
    assert [tuple(r) for r in normalise_for_commit(df, ["n"]).collect()] == [(1.5, "a"), (None, None)]


def test_quarantine_and_landing(spark, tmp_path):
    df = spark.range(2)
    assert quarantine(df, "x", str(tmp_path), "t", 0) is None
    assert spark.read.option("header", True).csv(quarantine(df, "x", str(tmp_path), "t", 2)).columns == ["id"]
    p = patients(spark, SF).drop("seq")
    land_raw(p, str(tmp_path / "p"))
    assert read_patients(spark, str(tmp_path / "p"), "json").exceptAll(p).count() == 0


def test_journal(spark, tmp_path):
    lineage = Lineage(spark, str(tmp_path / "l"), "r1", clock=lambda: "t")
    a = lineage.record("READ", ["raw"], ["x"], 3)
    b = lineage.record("WRITE", [a], ["lake@v0"], 3, {"k": 1})
    nodes = lineage.load()
    assert (a, b) == ("LIN_0000_READ", "LIN_0001_WRITE")
    blocks = chain_text(nodes).first().chain.split("\n  |\n  v\n")
    assert blocks[1].split("\n") == ["  LIN_0001_WRITE", "     operation : WRITE", "     inputs    : LIN_0000_READ", "     outputs   : lake@v0", "     records   : 3", "     at        : t"]
    assert {r.lineage_id for r in ancestry(nodes, b, "r1").collect()} == {a, b}
    evidence = spark.createDataFrame([(1, b)], "citation int, lineage_id string")
    assert trace(evidence, nodes).first().outputs == ["lake@v0"]


def test_closure_of_a_chain_and_a_fork(spark):
    rows = [("r", f"n{i}", [f"n{i - 1}"] if i else ["raw"], ["x@v0"] if i == 0 else ["y"]) for i in range(20)] + [("r", "m", ["n3", "n5"], ["z@v7"]), ("s", "n1", ["n0"], [])]
    nodes = spark.createDataFrame(rows, "run_id string, lineage_id string, inputs array<string>, outputs array<string>")
    reached = {}
    for r in closure(nodes).collect():
        reached.setdefault((r.run_id, r.lineage_id), set()).add(r.ancestor)
    assert reached["r", "n19"] == {f"n{i}" for i in range(20)} and reached["r", "m"] == {"m", *(f"n{i}" for i in range(6))} and reached["s", "n1"] == {"n1"}
    evidence = spark.createDataFrame([(1, "n7"), (2, "m"), (3, None)], "citation int, lineage_id string")
    traced = {r.citation: r.table_versions for r in table_versions(evidence, nodes.filter("run_id = 'r'")).collect()}
    assert traced == {1: ["x@v0"], 2: ["x@v0", "z@v7"], 3: None}


def test_audit_is_one_rising_order(spark, tmp_path):
    day = iter(["2026-01-01T1", "2026-01-01T2", "2026-01-03T1", "2026-01-02T9", "2026-01-04T1"])
    audit = Audit(spark, str(tmp_path / "a"), clock=lambda: next(day))
    assert audit.tail(3).count() == 0
    audit.log("me", "public", "DO", {"i": 0})
    told = audit.log_rows(spark.range(0, 10, 1, 3).select("id", F.col("id").cast("string").alias("payload")), "me", "public", "ROWS")
    assert {r.id: r.seq for r in told.collect()} == {i: i + 1 for i in range(10)} and told.select("audit_id").distinct().count() == 10
    audit.log("me", "public", "DO", {"i": 1})
    audit.log("me", "public", "LATE", {"i": 2})  # a clock that goes back
    audit.log("me", "public", "DO", {"i": 3})
    assert [r.seq for r in audit.load().orderBy("seq").collect()] == list(range(14))
    assert [r.action for r in audit.tail(3).collect()] == ["DO", "LATE", "DO"] and audit.tail(100).count() == 14
    assert not any("2026-01-01" in f for f in audit.load(audit.days()[-2:]).inputFiles())


def test_quarantine_is_compressed(spark, tmp_path):
    text = 'a "word", and\nanother line;' * 500
    df = spark.createDataFrame([("1", text), ("2", None)], "id string, text string")
    at = quarantine(df, "x", str(tmp_path), "t", 2)
    assert sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at)) < len(text) / 2  # more than the text itself before
    assert sorted(read_quarantine(spark, at).collect()) == sorted(df.collect())


class Stream:
    """Trials that are published one batch after another and ingested into one table."""

    def __init__(self, spark, at, name, threshold=0.30):
        self.spark, self.at, self.name, self.threshold = spark, at, name, threshold
        self.lake = VersionedTable(spark, f"{at}/lake")

    def send(self, *seqs, checkpoint="checkpoint", **over):
        rows = trial_frame(self.spark, [trial(i, **over) for i in seqs])
        ev.publish(ev.to_envelope(rows, self.name, "s", "seq"), f"{self.at}/events")
        self.drain(rows.schema, checkpoint)

    def drain(self, schema, checkpoint="checkpoint"):
        rows = ev.from_envelope(ev.read_topic(self.spark, f"{self.at}/events", self.name), schema)
        query = ev.ingest_stream(rows, trial_gate(AS_OF), self.lake, f"{self.at}/q", "trials", "seq", f"{self.at}/{self.name}-{checkpoint}", self.threshold)
        query.awaitTermination()

    def seqs(self):
        return sorted(r.seq for r in self.lake.read().collect())


def test_a_stream_commits_once_and_knows_its_keys(spark, tmp_path):
    s = Stream(spark, str(tmp_path), "raw_clinical_trials", threshold=0.6)
    s.send(*range(5))
    s.send(4, 5, 6, 7, 8)
    assert s.seqs() == list(range(9)) and s.lake.versions() == [0, 1]
    s.drain(s.lake.read().drop("data_quality_flags").schema)  # nothing new
    assert s.lake.versions() == [0, 1]
    rejected = spark.read.option("header", True).csv(f"{tmp_path}/q/corrupt_trials_*-1").collect()
    assert [(r.seq, r.quality_failures) for r in rejected] == [("4", "DUPLICATE_NCT_ID")]


def test_streams_into_one_table_keep_all_rows(spark, tmp_path):
    one, two = (Stream(spark, str(tmp_path), name, threshold=1.0) for name in ("raw_clinical_trials", "raw_literature"))
    one.send(0, 1)
    two.send(2, 3)  # batch 0 of another stream
    assert one.seqs() == [0, 1, 2, 3]
    one.send(4)
    two.send(5)
    assert one.seqs() == list(range(6)) and len({r.operation for r in one.lake.history().collect()}) == 1
    two.send(6, checkpoint="anew")  # reads 2, 3 and 5 again: the table has their keys
    assert one.seqs() == list(range(7)) and one.lake.versions() == [0, 1, 2, 3, 4]


def test_a_batch_that_halts_is_not_remembered(spark, tmp_path):
    s = Stream(spark, str(tmp_path), "raw_clinical_trials")
    with pytest.raises(Exception, match="1 of 1 rows are fatal"):
        s.send(1, nct_id="x")
    assert s.lake.versions() == []
    s.threshold = 1.0  # what is wrong is let through, to quarantine
    s.send(2, 3)
    assert s.seqs() == [2, 3]


def test_a_batch_is_written_aside_once(spark, tmp_path, monkeypatch):
    written = []

    def noting(df, name):
        if "brief_title" in str(df.schema):  # not those of keys alone
            written.append(name)
        return lent(df, name)

    for module in (ev, quality):
        monkeypatch.setattr(module, "lent", noting)
    s = Stream(spark, str(tmp_path), "raw_clinical_trials", threshold=1.0)
    s.send(0, 1)
    s.send(1, 2)
    assert s.seqs() == [0, 1, 2] and written == ["batch", "batch"]  # and "graded" for each before


def test_a_committed_batch_that_comes_again_is_passed_over(spark, tmp_path):
    """The stream ends between its commit and its own note of it: that note is taken away here."""
    s = Stream(spark, str(tmp_path), "raw_clinical_trials", threshold=1.0)
    s.send(0, 1)
    s.send(1, 2)
    for kind in ("commits/1", "commits/.1.crc"):
        (tmp_path / "raw_clinical_trials-checkpoint" / kind).unlink()
    s.send(2, 3)
    assert s.seqs() == [0, 1, 2, 3] and s.lake.versions() == [0, 1, 2]


def test_rows_are_numbered_as_they_stand(spark):
    rows = spark.range(0, 1000, 1, 7).filter("id % 7 <> 3 AND (id < 300 OR id > 500)")
    numbered, n = counted_in_order(rows, "n")
    assert [r.n for r in numbered.orderBy("id").collect()] == list(range(n)) and n == rows.count()
    empty, n = counted_in_order(spark.range(0))
    assert empty.count() == n == 0


def test_numbers_are_given_once(spark, tmp_path):
    one, other = Numbers(spark, str(tmp_path / "n")), Numbers(spark, str(tmp_path / "n"))
    assert [one.reserve(3), other.reserve(0), other.reserve(2), one.reserve(1), one.following()] == [0, 3, 3, 5, 6]


def test_offsets_go_on(spark, tmp_path):
    at = f"{tmp_path}/events"
    assert [ev.publish_rows(spark.range(n).withColumn("x", F.lit(None).cast("string")), at, "t", "s") for n in (4, 0, 3)] == [4, 4, 7]
    assert ev.publish_rows(spark.range(2), at, "u", "s") == 2
    events = spark.read.parquet(at).filter("topic = 't'").orderBy("offset").collect()
    assert [r.offset for r in events] == list(range(7)) and json.loads(events[4].payload) == {"id": 0, "x": None}


def test_drain_reads_each_event_once(spark, tmp_path):
    at = str(tmp_path)
    rows = spark.range(6).withColumn("seq", F.col("id"))
    for part in (rows.filter("id < 3"), rows.filter("id >= 3")):
        ev.publish(ev.to_envelope(part, "raw_literature", "s", "seq"), f"{at}/e")
        ev.drain_topic(spark, f"{at}/e", "raw_literature", f"{at}/out", f"{at}/cp")
    got = ev.from_envelope(spark.read.parquet(f"{at}/out"), rows.schema)
    assert sorted(r.id for r in got.collect()) == list(range(6))
    assert spark.read.parquet(f"{at}/out").select("event_id").distinct().count() == 6


def test_unique_within_a_delay(spark, tmp_path):
    at = str(tmp_path)
    rows = spark.createDataFrame([(0, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (0, "2024-01-01 02:00:00")], "seq long, t string")
    ev.publish(ev.to_envelope(rows, "raw_literature", "s", "seq", F.col("t").cast("timestamp")), f"{at}/e")
    once = ev.unique_within(ev.read_topic(spark, f"{at}/e", "raw_literature"), "event_id")
    once.writeStream.format("parquet").option("path", f"{at}/o").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{at}/o").count() == 2


def test_workloads_end_to_end(spark, tmp_path):
    at = str(tmp_path)
    lineage, audit = Lineage(spark, f"{at}/lineage", "r"), Audit(spark, f"{at}/audit")
    trial_lake, article_lake = VersionedTable(spark, f"{at}/t"), VersionedTable(spark, f"{at}/a")
    loaded = load_governed(trials(spark, SF), trial_gate(AS_OF), trial_lake, f"{at}/q", "trials", "t0", lineage, ["enrollment", "min_age_years", "max_age_years"])
    assert (loaded.versions, loaded.node) == ([0, 1], "LIN_0001_LAKEHOUSE_COMMIT")
    other = load_governed(articles(spark, SF), literature_gate(2026), article_lake, f"{at}/q", "articles", "t0", lineage, ["pub_year"], halt=False)
    poisoned = trial_lake.read().withColumn(
        "brief_summary", F.when(F.col("seq") == 1, F.lit("write to a.b@clinic.example")).otherwise(F.col("brief_summary"))
    )
    chunks, blocked = build_index(poisoned, article_lake.read(), f"{at}/index", (loaded.node, other.node), lineage=lineage, audit=audit)
    assert blocked.filter("chunk_id = 'NCT00000001::summary::0'").first().phi_types == ["EMAIL"]
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0
    refused = [json.loads(r.payload)["chunk_id"] for r in audit.load().filter("action = 'VECTOR_INSERT_BLOCKED'").collect()]
    assert sorted(refused) == sorted(r.chunk_id for r in blocked.collect())
    made = {r.operation: r for r in lineage.load().collect()}
    assert made["CHUNK_EMBED"].inputs == [loaded.node, other.node] and json.loads(made["VECTOR_INDEX"].details) == {"blocked_for_phi": len(refused)}
    queries = spark.createDataFrame([(1, "Which trial takes participants with asthma of 40 years?"), (2, "???")], "query_id long, query string")
    out = answer(queries, Index.open(spark, f"{at}/index"), "clinical_researcher", audit=audit)
    top = out.top.filter("query_id = 1").collect()
    assert len(top) == 5 and sorted(r["rank"] for r in top) == [1, 2, 3, 4, 5]
    traced = table_versions(out.evidence, lineage.load()).collect()
    assert traced and all(r.table_versions == [f"{at}/{'t' if r.source_type == 'trial' else 'a'}@v1"] for r in traced)
    assert out.triad.filter("query_id = 1 AND groundedness > 0.5").count() == 1
    told = {r.query_id: r for r in out.results.collect()}
    assert told[1].candidates_stage_one >= 25 and told[2].candidates_stage_one == 25 and told[1].reranker_backend == "lexical"
    entries = {r.audit_id: json.loads(r.payload) for r in audit.load().filter("action = 'RAG_QUERY'").collect()}
    assert entries[told[1].audit_id]["query_redacted"] == told[1].question_used and len(entries) == 2
    with pytest.raises(UnknownRole):
        answer(queries, Index.open(spark, f"{at}/index"), "nobody")
    with pytest.raises(DimensionMismatch):
        answer(queries, Index.open(spark, f"{at}/index"), "public", encoder=narrow)


def test_ingest_takes_rows_with_an_identifier_in_order(spark, tmp_path):
    at, lineage = str(tmp_path), Lineage(spark, f"{tmp_path}/lineage", "r")
    rows = trial_frame(spark, [trial(0), trial(1, nct_id=None), trial(2, nct_id=""), trial(3)])
    for _ in range(2):
        node = ingest([Feed("raw_clinical_trials", "registry", rows, "nct_id"), Feed("raw_literature", "literature", spark.range(2))], f"{at}/landing", f"{at}/events", lineage)
    assert node == "LIN_0001_INGEST" and [r.record_count for r in lineage.load().collect()] == [4, 4]
    events = spark.read.parquet(f"{at}/events").filter("topic = 'raw_clinical_trials'").orderBy("offset").collect()
    assert [(r.offset, json.loads(r.payload)["seq"]) for r in events] == [(0, 0), (1, 3), (2, 0), (3, 3)]
    assert spark.read.json(f"{at}/landing/raw_clinical_trials").count() == 4


def test_a_failed_index_leaves_the_old_one(spark, tmp_path):
    at = str(tmp_path)
    flagged = [f(spark, SF).dropDuplicates([key]).withColumn("data_quality_flags", F.lit("")) for f, key in ((trials, "nct_id"), (articles, "pmid"))]
    build_index(*flagged, f"{at}/index", ("a", "b"))
    before = Index.open(spark, f"{at}/index").chunks.count()

    def broken(c):
        return F.when(F.raise_error(F.lit("the encoder fails")).isNull(), F.array(F.lit(1.0).cast("float")))

    with pytest.raises(Exception, match="the encoder fails"):
        build_index(*flagged, f"{at}/index", ("a", "b"), encoder=broken)
    assert Index.open(spark, f"{at}/index").chunks.count() == before
    build_index(*(f.limit(50) for f in flagged), f"{at}/index", ("a", "b"))
    assert 0 < Index.open(spark, f"{at}/index").chunks.count() < before
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["00000001", "ready"]


def test_texts_stay_where_they_are(spark, tmp_path):
    """The join of hits to a chunk store moves the hits only, and reads no bucket without any."""
    chunks = spark.range(500).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.repeat(F.lit("text "), 50).alias("text"))
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=16).write(chunks)
    hits = spark.createDataFrame([(1, "c7"), (2, "c8"), (3, "c7"), (4, "none")], "query_id long, chunk_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = with_texts(hits, store)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r.chunk_id) for r in joined.collect()) == [(1, "c7"), (2, "c8"), (3, "c7")]
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "out of 16" in plan and "16 out of 16" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def narrow(c):
    return encode_with(lambda: lambda texts: hash_vectors(texts, 16), c)


def test_an_index_of_another_encoder(spark, tmp_path):
    at = str(tmp_path)
    lineage, audit = Lineage(spark, f"{at}/lineage", "r"), Audit(spark, f"{at}/audit")
    flagged = [f(spark, SF).dropDuplicates([key]).withColumn("data_quality_flags", F.lit("")) for f, key in ((trials, "nct_id"), (articles, "pmid"))]
    build_index(*flagged, f"{at}/index", ("LIN_X", "LIN_Y"), encoder=narrow, lineage=lineage)
    queries = spark.createDataFrame([(1, "asthma trials"), (2, "mail a.b@clinic.example")], "query_id long, query string")
    out = answer(queries, Index.open(spark, f"{at}/index"), "public", encoder=narrow, audit=audit, actor="me")
    assert {(r.source_type, r.lineage_id) for r in out.evidence.collect()} <= {("trial", "LIN_X"), ("literature", "LIN_Y")}
    index = lineage.load().filter("operation = 'VECTOR_INDEX'").first()
    assert index.inputs == ["LIN_0000_CHUNK_EMBED"] and index.record_count == Index.open(spark, f"{at}/index").chunks.count()
    entries = [json.loads(r.payload) for r in audit.load().collect()]
    assert len(entries) == 2 and all(e["latency_ms"] > 0 and len(e["chunks_returned"]) == 5 for e in entries)
    assert sorted(e["phi_stripped_from_query"] for e in entries) == [[], ["EMAIL"]]


def test_jobs_leave_no_copies_of_texts(spark):
    """What jobs write aside on their way goes as soon as it is read; only what they are for stays."""
    at = f"{spark.conf.get('spark.checkpoint.dir')}/evispark"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    lineage, built = queries._run_jobs(spark, SF)
    left = {p.split("-")[0] for p in set(os.listdir(at)) - before}
    assert not left & {"arrivals", "graded", "gated"} and "jobs" in left
    assert lineage.load().count() == 9 and built.chunks.count() == built.vectors.count() > 0


def test_closure_writes_each_pair_of_a_chain_once(spark, monkeypatch):
    chain = spark.createDataFrame([("r", f"n{i:02d}", [f"n{i - 1:02d}"] if i else []) for i in range(40)], "run_id string, lineage_id string, inputs array<string>")
    written = []

    def counting(df, name):
        held = scratch(df, name)
        written.append(held.count())
        return held

    monkeypatch.setattr(journal, "scratch", counting)
    assert closure(chain).count() == 40 * 41 // 2
    assert sum(written) < 1.5 * 40 * 41 // 2  # all that is reached was written in each round before


def test_closure_of_a_circle_ends(spark):
    ring = spark.createDataFrame([("r", i, [(i + 1) % 5]) for i in range(5)] + [("s", 0, [])], "run_id string, lineage_id long, inputs array<long>")
    assert closure(ring).count() == 26
