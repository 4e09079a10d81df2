"""Chunks of trials and articles for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splitting import OVERLAP, SIZE, split_rows
from ..functions.text import blank, number_text


#: What the key of a record without id begins with.
UNNAMED = "UNNAMED-"


def _or(name: str, absent: str) -> Column:
    """A column's text, or ``absent`` for null and empty."""
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(absent))


def _key(record_id: Column, *parts: Column) -> Column:
    unnamed = F.concat(F.lit(UNNAMED), F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 20))
    return F.coalesce(record_id, unnamed)


def _chunks(df: DataFrame, record_id: Column, source: str, header: Column, sections: dict[str, Column], carry: list[str], size: int, overlap: int) -> DataFrame:
    """One row for each piece of each section that isn't blank; carried columns ride along, so nothing is joined.

    A record without id has a key of its own in its chunks' ids, from its header and bodies; only records that are alike in all
    of these share it.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(f"[{n.upper()}] ").alias("tag"), F.coalesce(c, F.lit("")).alias("body")) for n, c in sections.items()])
    parts = (
        df.select(*carry, record_id.alias("record_id"), _key(record_id, header, *sections.values()).alias("_key"), header.alias("_header"), F.explode(listed).alias("s"))
        .select("*", "s.section", "s.body", F.concat("_header", "s.tag").alias("_head"))
        .drop("s", "_header")
        .filter(~blank(F.col("body")))
    )
    return split_rows(parts, "body", size, overlap, "_head").select(
        F.concat_ws("::", "_key", "section", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.lit(source).alias("source_type"),
        "record_id",
        "section",
        "chunk_index",
        F.col("_piece").alias("text"),
        *carry,
    )


def chunk_trials(df: DataFrame, carry: list[str] | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of trials: summary, eligibility with the age, sex and enrollment facts in front, interventions.

    Each begins with the trial's id, title, status, phase and conditions. Null texts are empty; ``carry`` names the
    trial columns that the chunks keep (nct_id by default).
    """
    text = lambda name: F.coalesce(name, F.lit(""))
    header = F.concat(
        *(F.lit("Trial "), text("nct_id"), F.lit(" - "), text("brief_title"), F.lit("\nStatus: "), text("overall_status")),
        *(F.lit(" | Phase: "), _or("phase", "N/A"), F.lit(" | Conditions: "), text("conditions"), F.lit("\n")),
    )
    facts = F.concat(
        *(F.lit("Eligible ages: "), number_text(F.col("min_age_years"), "unspecified")),
        *(F.lit(" to "), number_text(F.col("max_age_years"), "no upper limit")),
        *(F.lit(" years. Sex eligible: "), _or("sex", "unspecified")),
        *(F.lit(". Enrollment target: "), number_text(F.col("enrollment"), "unspecified"), F.lit(".\n")),
    )
    sections = {"summary": F.col("brief_summary"), "eligibility": F.concat(facts, text("eligibility_criteria")), "interventions": F.col("interventions")}
    return _chunks(df, F.col("nct_id"), "trial", header, sections, carry or ["nct_id"], size, overlap)


def chunk_articles(df: DataFrame, carry: list[str] | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of articles: abstract and citation, each with id, title, journal, year and types in front."""
    text = lambda name: F.coalesce(name, F.lit(""))
    header = F.concat(
        *(F.lit("Article PMID "), text("pmid"), F.lit(" - "), text("title"), F.lit("\n"), _or("journal", "Unknown journal")),
        *(F.lit(" ("), _or("pub_year", "n.d."), F.lit(") | "), _or("publication_types", "Journal Article"), F.lit("\n")),
    )
    citation = F.concat(
        *(_or("authors", "Unknown authors"), F.lit(". "), text("title"), F.lit(". "), text("journal"), F.lit(" ")),
        *(_or("pub_year", ""), F.lit(". doi:"), _or("doi", "n/a")),
    )
    record = F.concat(F.lit("PMID"), F.col("pmid"))
    return _chunks(df, record, "literature", header, {"abstract": F.col("abstract"), "citation": citation}, carry or ["pmid"], size, overlap)


TRIAL_FACTS = ["nct_id", "source_url", "overall_status", "phase", "min_age_years", "max_age_years", "last_update", "data_quality_flags"]
ARTICLE_FACTS = ["pmid", "source_url", "journal", "pub_year", "data_quality_flags"]


def enrich_chunks(chunks: DataFrame, lineage_id: str) -> DataFrame:
    """With lineage_id and the class of the text, which is public."""
    return chunks.withColumns({"lineage_id": F.lit(lineage_id), "classification": F.lit("PUBLIC")})


def all_chunks(trials: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunks of both sources in one table; what only one has is null in the other."""
    return trials.unionByName(articles, allowMissingColumns=True)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count("*").alias("chunks"))
