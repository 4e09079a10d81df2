"""From nested registry studies and literature XML to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_age_years
from ..functions.xml import with_article_parts


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(items: Column, sep: str = "; ") -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), sep)


def flatten_studies(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 18 trial columns (and ``keep``) of nested studies; a missing level gives null, a missing list an empty text.

    At most six interventions (``TYPE: name``, type OTHER if missing), and distinct places in order of first
    appearance, the first 400 characters.
    """
    p = F.col("protocolSection")
    drugs = F.slice(F.coalesce(p["armsInterventionsModule"]["interventions"], F.array().cast("array<struct<type: string, name: string>>")), 1, 6)
    named = F.transform(drugs, lambda d: F.trim(F.concat(F.coalesce(d["type"], F.lit("OTHER")), F.lit(": "), _or_empty(d["name"]))))
    places = F.transform(
        p["contactsLocationsModule"]["locations"],
        lambda x: F.array_join(F.filter(F.array(x["city"], x["state"], x["country"]), lambda part: part != ""), ", "),
    )
    nct_id = p["identificationModule"]["nctId"]
    eligible = p["eligibilityModule"]
    return df.select(
        *keep,
        nct_id.alias("nct_id"),
        p["identificationModule"]["briefTitle"].alias("brief_title"),
        p["statusModule"]["overallStatus"].alias("overall_status"),
        p["statusModule"]["lastUpdatePostDateStruct"]["date"].alias("last_update"),
        p["descriptionModule"]["briefSummary"].alias("brief_summary"),
        _joined(p["conditionsModule"]["conditions"]).alias("conditions"),
        p["designModule"]["studyType"].alias("study_type"),
        _joined(p["designModule"]["phases"]).alias("phase"),
        p["designModule"]["enrollmentInfo"]["count"].cast("double").alias("enrollment"),
        eligible["eligibilityCriteria"].alias("eligibility_criteria"),
        parse_age_years(eligible["minimumAge"]).alias("min_age_years"),
        parse_age_years(eligible["maximumAge"]).alias("max_age_years"),
        eligible["sex"].alias("sex"),
        eligible["healthyVolunteers"].alias("healthy_volunteers"),
        _joined(named).alias("interventions"),
        F.substring(_joined(F.array_distinct(places)), 1, 400).alias("locations"),
        p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("sponsor"),
        F.concat(F.lit("https://clinicaltrials.gov/study/"), _or_empty(nct_id)).alias("source_url"),
    )


def with_identifier(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither null nor empty."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def flatten_articles(df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """The nine article columns (and ``keep``) of ``<PubmedArticle>`` fragments; a fragment that can't be parsed gives no row.

    Sections stand on lines of their own, labelled ones as ``LABEL: body``. Of authors the first six count, without
    those that have no last name; of DOIs the last; of publication types the first four.
    """
    a = F.col("a")
    body = F.transform(a["sections"], lambda s: F.when(_or_empty(s["label"]) != "", F.concat(s["label"], F.lit(": "), s["body"])).otherwise(s["body"]))
    authors = F.filter(F.slice(a["authors"], 1, 6), lambda x: _or_empty(x["last_name"]) != "")
    names = F.transform(authors, lambda x: F.trim(F.concat(x["last_name"], F.lit(" "), _or_empty(x["initials"]))))
    year = F.coalesce(F.nullif(a["year"], F.lit("")), F.substring(a["medline_date"], 1, 4))
    dois = F.filter(a["ids"], lambda i: i["kind"] == "doi")
    pmid = a["pmid"]
    return (
        with_article_parts(df.select(*keep, xml), xml, "a").select(
            *keep,
            pmid.alias("pmid"),
            a["title"].alias("title"),
            F.nullif(F.array_join(body, "\n"), F.lit("")).alias("abstract"),
            a["journal"].alias("journal"),
            F.when(year.rlike(r"^\d+$"), year.try_cast("int")).alias("pub_year"),
            F.array_join(names, "; ").alias("authors"),
            F.array_join(F.slice(a["publication_types"], 1, 4), "; ").alias("publication_types"),
            _or_empty(F.try_element_at(dois, F.lit(-1))["value"]).alias("doi"),
            F.when(_or_empty(pmid) != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise("").alias("source_url"),
        )
    )


def unread_articles(df: DataFrame, xml: str = "xml") -> DataFrame:
    """The fragments that give no article: broken ones, and any with a document type."""
    return with_article_parts(df, xml, "_a", read=False)
