"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of ``documents``, and
only those: other columns are left behind, so none can clash with what a stage uses. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import minhash, mixing, pieces, quality, substrings
from evispark.llm.common import documents, written

MODEL = "piece_bpe_32k.model"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees fitted to ``labels`` go.

    Rows are judged one by one by their text alone: null and empty texts have under 10 words and go, long ones are
    judged as a whole, repeated rows and copies share a verdict, null doc_ids, langs and sources don't matter.
    """
    docs = docs.select(COLUMNS)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.grade(docs, model).filter("kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) one row stays: that with the smallest doc_id.

    Rows are compared, not doc_ids: a row that stands twice keeps one, and a text that is like no other stays, whatever
    else has its doc_id. A null doc_id counts as larger than all; ties go by the order in which rows are numbered.
    Null and empty texts are like nothing and stay. Long texts are compared as a whole.
    """
    rows = written(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    grouped = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), n=5, percent=80)
    placed = grouped.select(F.col("doc_id").alias("row"), F.col("component_id").alias("part")).join(rows.select("row", "doc_id"), "row")
    best = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    gone = written(rows.select("row").join(best.select("best.row"), "row", "left_anti"), "gone")  # Spark broadcasts it if small
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that a smaller doc_id has go; so does a document of which no word is left.

    Null and empty texts, texts under 50 words and null doc_ids stay as they are; rows that share a doc_id don't cut one
    another; long texts are cut as a whole. n_chars is that of what is left; the other columns stay.
    """
    cut = substrings.dedup(docs.select(COLUMNS)).filter("n_words = 0 OR n_removed < n_words")
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: each document is left out or stands once or up to three times.

    A null source is one of its own. Rows alike in all columns are chosen one by one, as are rows that share a doc_id or
    have none. Null and empty texts have no words; those under their source's threshold stay. Long texts are taken whole.
    """
    return mixing.mixed_rows(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text that is left, with the round trip and parity checks.

    A row for each row: null and empty texts have no ids, long ones are encoded whole, repeated rows alike; null doc_ids,
    langs and sources are carried along.
    """
    model = pieces.PieceModel.load(public_tokenizers.path(MODEL))
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), model).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("sentencepiece", encode),
]

#: SQL cannot express the fitted trees, nor the encoding; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
