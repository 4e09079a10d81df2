"""The landing zone: raw studies, literature XML and patients; quarantine for what is rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PATIENT, STUDY, parsed


def read_studies(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Raw studies, one to a line; ``multiline`` reads files that are one JSON array, each in one task."""
    return spark.read.schema(parsed(STUDY)).option("multiLine", multiline).json(path)


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """(xml): one ``<PubmedArticle>`` fragment for each row; text outside of articles gives none.

    Files are cut at the closing tag, so a large file is read by many tasks.
    """
    end = "</PubmedArticle>"
    raw = spark.read.option("lineSep", end).text(path)
    start = F.regexp_extract("value", r"(?s)(<PubmedArticle[\s>].*)$", 1)
    return raw.select(F.when(start != "", F.concat(start, F.lit(end))).alias("xml")).filter("xml IS NOT NULL")


def read_patients(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(parsed(PATIENT))
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def land_raw(df: DataFrame, path: str) -> None:
    """Keep source rows as they came: one text column as lines, anything else as JSON lines; a compressed file for each task."""
    writer = df.write.mode("overwrite").option("compression", "gzip")
    if [t for _, t in df.dtypes] == ["string"]:
        writer.text(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def quarantine(rejected: DataFrame, label: str, path: str, stamp: str, count: int) -> str | None:
    """Write rejected rows as compressed CSV with a header under ``path``; nothing if the batch report counts none."""
    if not count:
        return None
    at = f"{path.rstrip('/')}/corrupt_{label}_{stamp}"
    rejected.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip").csv(at)
    return at


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """What quarantine() wrote, as text columns; a value may go over several lines."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
