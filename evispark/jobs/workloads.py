"""The three workloads: build governed tables, build the index, answer a table of questions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phi import is_gated
from ..functions.vectors import hash_embed
from ..operators import answers as A
from ..operators import fhir
from ..operators import retrieval as R
from ..operators.chunking import ARTICLE_FACTS, TRIAL_FACTS, all_chunks, chunk_articles, chunk_trials, enrich_chunks
from ..operators.flatten import with_identifier
from ..operators.governance import blocked_report, check_role, deidentify, phi_summary, redact_queries
from ..operators.index import ChunkStore, check_dimensions, encoder_width, index_stats, posted_stats, postings, term_stats, vectors_of, write_entries
from ..operators.quality import Gate, clean_rows, enforce, graded_once, rejected_rows
from ..operators.retrieval import few
from ..scratch import lent, scratch, swept
from ..sources.files import land_raw, quarantine
from ..sources.folders import create, drop, found, size
from ..sources.journal import Audit, Lineage
from ..sources.numbers import Numbers
from ..sources.versions import VersionedTable, incremental_load, normalise_for_commit
from ..streaming.events import publish_rows

#: A column of texts to a column of vectors.
Encoder = Callable[[Column], Column]
#: Chunks that are looked up by name at most; more stand in nearly all buckets, and are found by a join alone.
LOOKED_UP = 1_000
#: Bytes of written chunks that are shuffled at once (in shuffle files they take some three times that), and rounds at most.
ROUND, ROUNDS = 1 << 31, 8


@dataclass
class Feed:
    """Rows of one source, the topic that they go to, and the column without which a row is not taken."""

    topic: str
    source: str
    rows: DataFrame
    identifier: str | None = None


def ingest(feeds: list[Feed], landing: str, events: str, lineage: Lineage, event_time: Column | None = None) -> str:
    """Keep each source's rows as they came, publish those with an identifier to their topics in order, and record an INGEST
    node; its id."""
    published = 0
    for feed in feeds:
        land_raw(feed.rows, f"{landing.rstrip('/')}/{feed.topic}")
        rows = with_identifier(feed.rows, feed.identifier) if feed.identifier else feed.rows
        before = Numbers(feed.rows.sparkSession, f"{events.rstrip('/')}-offsets/{feed.topic}").following()
        published += publish_rows(rows, events, feed.topic, feed.source, event_time) - before
    return lineage.record("INGEST", [f.source for f in feeds], [f"topic:{f.topic}" for f in feeds], published, {"landing": landing})


@dataclass
class Loaded:
    """New versions of a table, and the lineage node of their commit."""

    versions: list[int]
    node: str


def load_governed(
    df: DataFrame, gate: Gate, lake: VersionedTable, quarantine_path: str, label: str, stamp: str, lineage: Lineage, numeric: list[str], order: str = "seq", halt: bool = True, after: str | None = None
) -> Loaded:
    """Grade rows, quarantine the rejected, halt if too many are, and commit the clean ones. The nodes of both follow ``after``."""
    with graded_once(df, gate, order) as graded:
        counts = graded.verdict.first()
        quarantine(rejected_rows(graded.rows), label, quarantine_path, stamp, counts["rejected"])
        report = {r["metric"]: r["violations"] for r in graded.report.collect()}  # a row for each check
        details = {"rejected": counts["rejected"], "violations": report}
        checked = lineage.record("QUALITY_GATE", [after or label], [f"clean_{label}", "quarantine_zone"], counts["clean"], details)
        if halt:
            enforce(graded.verdict)
        clean = normalise_for_commit(clean_rows(graded.rows), numeric)
        versions = incremental_load(clean, lake, order)
    return Loaded(versions, lineage.record("LAKEHOUSE_COMMIT", [checked], [f"{lake.path}@v{versions[-1]}"], counts["clean"]))


def govern(trials: DataFrame, patients: DataFrame, salt: str, lineage: Lineage, audit: Audit, after: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check both kinds of records against their profiles, then de-identify the patients.

    Returns (conformance of both, safe patients, findings by family), records a lineage node and an audit entry for each
    step; the first follows the node ``after``.
    """
    reports = scratch(
        fhir.conformance_report(fhir.validated(patients, "Patient")).unionByName(fhir.conformance_report(fhir.validated(trials, "ResearchStudy"))), "conformance"
    )
    details = {r["resource_type"]: r.asDict() for r in reports.collect()}  # two rows
    n = sum(r["resources_validated"] for r in details.values())
    checked = lineage.record("FHIR_VALIDATION", [after], ["fhir_conformance_report"], n, details)
    audit.log("pipeline", "data_engineer", "FHIR_VALIDATION", details)
    safe, findings = deidentify(patients, salt)
    hits = scratch(phi_summary(findings), "findings")
    removed = {r["type"]: r["hits"] for r in hits.collect()}  # a row for each family
    records = details["Patient"]["resources_validated"]
    lineage.record("PHI_DEIDENTIFICATION", [checked], ["deidentified_patient_profiles"], records, {"phi_removed": sum(removed.values())})
    payload = {"records": records, "phi_removed": sum(removed.values()), "phi_types": sorted(removed)}
    audit.log("pipeline", "data_engineer", "PHI_DEIDENTIFICATION", payload)
    return reports, safe, hits


def build_index(
    trials: DataFrame,
    articles: DataFrame,
    path: str,
    nodes: tuple[str, str],
    encoder: Encoder | None = None,
    lineage: Lineage | None = None,
    audit: Audit | None = None,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Chunk, gate, embed and write both sources; (chunks of the index, report of blocked chunks).

    ``nodes`` are those of the commits that the trials and the articles were read from; chunks carry them, so evidence leads to
    a version of its table. Chunks are gated before they are embedded, so blocked text is never encoded; ``encoder`` stands in
    for the hashed embedding. With ``audit`` an entry is appended for each blocked chunk, with ``lineage`` nodes for chunks and
    index. The index is a new generation under ``path``; the one before goes when it is there, and stays if the job fails.
    """
    spark = trials.sparkSession
    every = all_chunks(enrich_chunks(chunk_trials(trials, TRIAL_FACTS), nodes[0]), enrich_chunks(chunk_articles(articles, ARTICLE_FACTS), nodes[1]))
    old = _generation(spark, path)
    at = f"{path.rstrip('/')}/{old + 1:08d}"
    drop(spark, at)  # what a failed job has left
    with lent(every.withColumn("_gated", is_gated(F.col("text"))), "gated") as gated:
        blocked = scratch(blocked_report(gated.filter("_gated")), "blocked")
        if audit is not None:
            payload = F.to_json(F.struct("chunk_id", "phi_types"))
            audit.log_rows(blocked.select(payload.alias("payload")), "pipeline", "data_engineer", "VECTOR_INSERT_BLOCKED")
        admitted = gated.filter("NOT _gated").drop("_gated")
        rounds = min(ROUNDS, 1 + size(spark, gated.inputFiles()) // ROUND)
        chunks = ChunkStore(spark, f"{at}/chunks", buckets).write(admitted, rounds=rounds)
        dims, stats = write_entries(admitted, f"{at}/entries", encoder)  # in order of records, whose chunks share most terms
    dims.write.parquet(f"{at}/dims")
    stats.write.parquet(f"{at}/stats")
    with swept(spark):
        term_stats(spark.read.parquet(f"{at}/entries"), stats.select("n")).write.parquet(f"{at}/terms")
    create(spark, f"{path.rstrip('/')}/ready/{old + 1:08d}")
    if old >= 0:
        for gone in (f"ready/{old:08d}", f"{old:08d}"):
            drop(spark, f"{path.rstrip('/')}/{gone}")
    if lineage:
        dims = spark.read.parquet(f"{at}/dims").first()
        n_blocked = blocked.count()
        cut = lineage.record("CHUNK_EMBED", list(dict.fromkeys(nodes)), ["chunk_vectors"], dims["chunks"] + n_blocked, {"dimensions": dims["max_dim"]})
        lineage.record("VECTOR_INDEX", [cut], [f"index:{path}"], dims["chunks"], {"blocked_for_phi": n_blocked})
    return chunks, blocked


def _generation(spark: SparkSession, path: str) -> int:
    """The newest generation of an index that is complete, or -1."""
    return max((int(p.rsplit("/", 1)[1]) for p in found(spark, f"{path.rstrip('/')}/ready/*")), default=-1)


@dataclass
class Index:
    """A written index: chunks by id, their vectors, postings, term weights, corpus statistics, the vectors' width."""

    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    dims: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        at = f"{path.rstrip('/')}/{_generation(spark, path):08d}"
        entries = spark.read.parquet(f"{at}/entries")
        held = ChunkStore(spark, f"{at}/chunks").read(), vectors_of(entries), entries.select("chunk_id", "doc_len", "terms")
        return cls(*held, *(spark.read.parquet(f"{at}/{t}") for t in ("terms", "stats", "dims")))

    @classmethod
    def over(cls, chunks: DataFrame) -> Index:
        """An index over chunks with vectors that isn't written."""
        posted = postings(chunks)
        stats = posted_stats(posted)
        return cls(chunks.drop("vector"), chunks.select("chunk_id", "vector"), posted, term_stats(posted, stats.select("n")), stats, index_stats(chunks))


@dataclass
class Answers:
    queries: DataFrame
    top: DataFrame
    alerts: DataFrame
    context: DataFrame
    answers: DataFrame
    evidence: DataFrame
    triad: DataFrame
    audit: DataFrame
    results: DataFrame


def candidates(queries: DataFrame, index: Index, k: int = 25, encoder: Encoder | None = None) -> DataFrame:
    """(query_id, chunk_id, ...): dense and sparse lists of k, fused; no text yet."""
    dense = R.dense_topk(queries.select("query_id", (encoder or hash_embed)(F.col("query")).alias("vector")), index.vectors, k, digits=6)
    sparse = R.sparse_topk(R.query_terms(queries), index.postings, index.terms, index.stats, k)
    return R.rrf_fuse(dense, sparse)


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with the columns of its chunks. It is dealt to the chunks' buckets, so texts stay where they are; if it names few
    chunks, buckets without any are not read."""
    ids = few(hits.select("chunk_id").distinct(), LOOKED_UP)
    held = chunks if ids is None else chunks.filter(F.col("chunk_id").isin([r["chunk_id"] for r in ids]))
    return hits.hint("shuffle_hash").join(held, "chunk_id")


def answer(
    queries: DataFrame,
    index: Index,
    role: str,
    k: int = 25,
    n: int = 5,
    protect_ids: bool = False,
    encoder: Encoder | None = None,
    scorer: Callable[[Column, Column], Column] | None = None,
    audit: Audit | None = None,
    actor: str = "researcher",
) -> Answers:
    """Answer a table of questions (query_id, query); an unknown role, or an encoder of another width than the index has,
    is refused before anything else is read.

    ``encoder`` (text to vector column) must be the one that the index was built with, ``scorer`` (question and text to
    score column) stands in for the lexical reranking. With ``audit`` an entry for each question is appended, with the
    time that answering all of them took.
    """
    check_role(role)
    check_dimensions(index.dims, encoder_width(queries.sparkSession, encoder))
    began = time.perf_counter()
    redacted = redact_queries(queries, protect_ids)
    asked = redacted.select("query_id", F.col("query_redacted").alias("query"))
    hits = scratch(candidates(asked, index, k, encoder), "candidates")  # 2 k rows for each question
    texts = with_texts(hits, index.chunks).join(asked, "query_id")
    if scorer is None:
        texts = R.lexical_rerank(texts, asked, R.rerank_idf(index.terms.select("term", "df"), index.stats))
    top = scratch(R.rerank(texts, n, scorer), "top")  # n rows for each question, read five times
    alerts = R.age_conflicts(top.dropDuplicates(["chunk_id"])).join(top.select("query_id", "chunk_id"), "chunk_id")
    given = A.extractive_answer(top)
    triad = scratch(A.rag_triad(asked.join(given, "query_id", "left").fillna("", ["answer"]), top.select("query_id", "text"), encoder or hash_embed), "triad")
    cited = A.evidence(top)
    latency = round((time.perf_counter() - began) * 1000, 1)
    entries = A.audit_rows(redacted, cited, triad, alerts, latency_ms=latency)
    logged = entries.withColumn("audit_id", F.lit(None).cast("string")) if audit is None else audit.log_rows(entries, actor, role, "RAG_QUERY")
    counted = hits.groupBy("query_id").agg(F.count("*").alias("candidates_stage_one"))
    named = {"embedding": "hashing" if encoder is None else "encoder", "reranker": "lexical" if scorer is None else "scorer", "llm": "extractive"}
    results = (
        redacted.select("query_id", F.col("query_redacted").alias("question_used"))
        .join(given, "query_id", "left")
        .join(counted, "query_id", "left")
        .join(logged.select("query_id", "audit_id"), "query_id", "left")
        .withColumns({"candidates_stage_one": F.coalesce("candidates_stage_one", F.lit(0)), "latency_ms": F.lit(latency)})
        .withColumns({f"{n}_backend": F.lit(v) for n, v in named.items()})
    )
    return Answers(asked, top, alerts, A.build_context(top), given, cited, triad, entries, results)
