"""One query for each operator, over the whole ``documents`` table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, fingerprints, language, lines, minhash, mixing, periods, pieces, quality, sharding, substrings, suffixes, token_counts
from .common import documents
from .oracles import ORACLES  # noqa: F401

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "kept_text")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), n=4, percent=80)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.grade(docs.select("doc_id", "text"), model).drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.held_out(documents(spark, sf_dir))
    dictionaries = language.learn(docs.filter(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "text", "held_out"), dictionaries).drop("text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.load(public_tokenizers.path(MODEL))
    return pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), model).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.load(public_tokenizers.path(MODEL))
    return token_counts.count_tokens(documents(spark, sf_dir), model, limit=4096)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "kept_text")
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return found.withColumn("removed", F.array_join(spans, ","))  # as 3-60,90-140


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    keep = F.array_join(F.col("keep").cast("array<string>"), ",")  # as 0,2,5
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256", keep.alias("keep"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = align.ByteModel.load(public_tokenizers.path(BYTE_MODEL)), pieces.PieceModel.load(public_tokenizers.path(MODEL))
    return align.align(documents(spark, sf_dir).select("doc_id", "text"), a, b)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return periods.run_digests(periods.collapse(docs.select("doc_id", periods.looped(F.col("doc_id"), F.col("text")).alias("text"))))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_dedup, op3_fingerprints, op4_quality_rules, op5_language_id, op6_sharding, op7_mixing, op8_sentencepiece, op9_token_counts, op10_suffix_array_dedup, op11_line_dedup, op12_alignment, op13_periodic_runs)}
