"""Contexts, extractive answers, evidence, scores and audit rows for answered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.text import tokenize
from ..functions.vectors import cosine, hash_embed


def _ordered(value: Column) -> Column:
    """Values of a question's rows in order of rank: at most as many as were reranked."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("value")))), lambda x: x["value"])


def build_context(top: DataFrame, system: str = "") -> DataFrame:
    """(query_id, context, prompt): numbered blocks with blank lines between, and the whole prompt."""
    numbered = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    context = F.array_join(_ordered(numbered), "\n\n")
    prompt = F.format_string(policy.PROMPT, F.lit(system), F.col("context"), F.coalesce("query", F.lit("")))
    return top.groupBy("query_id", "query").agg(context.alias("context")).withColumn("prompt", prompt).select("query_id", "context", "prompt")


def extractive_answer(top: DataFrame, length: int = 400) -> DataFrame:
    """(query_id, answer): each block's beginning, white space collapsed, with its number, under a fixed first line."""
    squeezed = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    quoted = F.concat(F.substring(squeezed, 1, length), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    return top.groupBy("query_id").agg(F.concat(F.lit(policy.EXTRACTIVE + "\n\n"), F.array_join(_ordered(quoted), "\n\n")).alias("answer"))


def evidence(top: DataFrame) -> DataFrame:
    """The 13 evidence columns of each reranked chunk, with query_id."""
    or_else = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), b)
    return top.select(
        "query_id",
        F.col("rank").alias("citation"),
        or_else("source_type", F.lit("trial")).alias("source_type"),
        or_else("record_id", F.col("nct_id")).alias("record_id"),
        "nct_id",
        "chunk_id",
        "section",
        "lineage_id",
        F.coalesce("retrieved_by", F.lit("dense")).alias("retrieved_by"),
        F.round("rrf_score", 6).alias("rrf_score"),
        F.round("rerank_score", 4).alias("rerank_score"),
        "source_url",
        F.coalesce("data_quality_flags", F.lit("")).alias("quality_flags"),
        F.coalesce("last_update", F.lit("")).alias("last_update"),
    )


def content_tokens(c: Column) -> Column:
    """Distinct tokens of more than two characters that are not stop words."""
    return F.array_distinct(F.filter(tokenize(c), lambda t: (F.length(t) > 2) & ~t.isin(*policy.STOP_WORDS)))


def rag_triad(answers: DataFrame, contexts: DataFrame, embed=hash_embed, digits: int = 4) -> DataFrame:
    """(query_id, context_relevance, groundedness, answer_relevance), four decimals, for each answered question.

    ``answers``: (query_id, query, answer); ``contexts``: (query_id, text), a few for each question. Without contexts
    all three are 0.
    """
    vectors = answers.select("query_id", embed(F.col("query")).alias("qv"), embed(F.col("answer")).alias("av"), content_tokens(F.col("answer")).alias("at"))
    held = contexts.select("query_id", embed(F.col("text")).alias("cv"), content_tokens(F.col("text")).alias("ct"))
    near = (
        held.join(vectors.select("query_id", "qv"), "query_id")
        .groupBy("query_id")
        .agg(F.avg(cosine(F.col("qv"), F.col("cv"))).alias("near"), F.array_distinct(F.flatten(F.collect_list("ct"))).alias("ct"))
    )
    floor = lambda c: F.round(F.greatest(c, F.lit(0.0)), digits)
    has = F.col("near").isNotNull()
    grounded = F.when(F.size("at") > 0, F.size(F.array_intersect("at", "ct")) / F.size("at")).otherwise(F.lit(0.0))
    return vectors.join(near, "query_id", "left").select(
        "query_id",
        F.when(has, floor(F.col("near"))).otherwise(0.0).alias("context_relevance"),
        F.when(has, F.round(grounded, digits)).otherwise(0.0).alias("groundedness"),
        F.when(has, floor(cosine(F.col("qv"), F.col("av")))).otherwise(0.0).alias("answer_relevance"),
    )


def audit_rows(redacted: DataFrame, found: DataFrame, triad: DataFrame, alerts: DataFrame, backend: str = "extractive", latency_ms: float | None = None) -> DataFrame:
    """(query_id, payload): what the audit keeps of each question, as JSON; never its raw text. ``latency_ms`` is that of
    the job that answered them all."""
    cited = found.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("citation", F.concat_ws(":", "source_type", "record_id").alias("s")))), lambda x: x["s"]
        ).alias("sources_returned"),
        F.transform(F.array_sort(F.collect_list(F.struct("citation", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks_returned"),
    )
    counted = alerts.groupBy("query_id").agg(F.count("*").alias("contradiction_alerts"))
    joined = redacted.join(cited, "query_id", "left").join(triad, "query_id", "left").join(counted, "query_id", "left")
    payload = F.struct(
        F.col("query_redacted"),
        F.col("query_hash"),
        F.col("phi_stripped").alias("phi_stripped_from_query"),
        F.coalesce("sources_returned", F.array().cast("array<string>")).alias("sources_returned"),
        F.coalesce("chunks_returned", F.array().cast(dict(found.select(F.array("chunk_id").alias("c")).dtypes)["c"])).alias("chunks_returned"),
        F.struct("context_relevance", "groundedness", "answer_relevance").alias("rag_triad"),
        F.coalesce("contradiction_alerts", F.lit(0)).alias("contradiction_alerts"),
        F.lit(backend).alias("llm_backend"),
        F.lit(latency_ms).cast("double").alias("latency_ms"),
    )
    return joined.select("query_id", F.to_json(payload).alias("payload"))
