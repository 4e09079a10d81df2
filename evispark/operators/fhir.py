"""FHIR resources from flat rows, and what keeps them from conforming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.text import exploded, strip


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def patient_resource() -> Column:
    """A ``Patient`` struct from the patient columns: the last word of the name is the family, the others are given."""
    words = F.array_compact(F.filter(F.split(F.coalesce(_text("patient_name"), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    given = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    name = _named(use=F.lit("official"), family=F.try_element_at(words, F.lit(-1)), given=F.when(F.size(given) > 0, given))
    identifier = _named(system=F.lit("urn:oid:2.16.840.1.113883.4.1"), value=_text("medical_record_number"))
    telecom = [_named(system=F.lit(s), value=_text(s)) for s in ("phone", "email")]
    return _named(
        resourceType=F.lit("Patient"),
        identifier=F.array(identifier),
        active=F.lit(True),
        name=F.array(name),
        telecom=F.array(*telecom),
        gender=_text("gender"),
        birthDate=_text("date_of_birth"),
        address=F.array(_named(text=_text("address"))),
    )


def study_resource() -> Column:
    """A ``ResearchStudy`` struct from the trial columns; a status without a counterpart gives a null status."""
    raw = F.upper(F.coalesce(_text("overall_status"), F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in policy.STUDY_STATUS_OF.items() for x in pair])
    parts = F.transform(F.split(F.coalesce(_text("conditions"), F.lit("")), ";"), strip)
    return _named(
        resourceType=F.lit("ResearchStudy"),
        identifier=F.array(_named(system=F.lit("https://clinicaltrials.gov"), value=_text("nct_id"))),
        title=_text("brief_title"),
        status=F.try_element_at(table, raw),
        sourceStatus=raw,
        phase=_named(text=F.coalesce(F.nullif(_text("phase"), F.lit("")), F.lit("N/A"))),
        condition=F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(x.alias("text"))),
        description=_text("brief_summary"),
        enrollment=F.col("enrollment"),
        sponsor=_named(display=_text("sponsor")),
    )


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def patient_issues(r: Column) -> Column:
    """array<string>: what keeps a Patient struct from conforming; empty if nothing does."""
    email = F.try_element_at(F.filter(r["telecom"], lambda t: t["system"] == "email"), F.lit(1))["value"]
    says = policy.PATIENT_ISSUES
    return F.array_compact(
        F.array(
            F.when(_missing(r["identifier"][0]["value"]), says["identifier"]),
            F.when(_missing(r["name"][0]["family"]), says["family"]),
            F.when(~r["gender"].isin(*policy.GENDERS), F.format_string(says["gender"], r["gender"])),
            F.when(~r["birthDate"].rlike(policy.FHIR_DATE), F.format_string(says["birth_date"], r["birthDate"])),
            F.when((email != "") & ~email.rlike(f"(?U){policy.EMAIL_ADDRESS}"), F.format_string(says["email"], email)),
        )
    )


def study_issues(r: Column) -> Column:
    """array<string>: what keeps a ResearchStudy struct from conforming; empty if nothing does."""
    enrolled, status, says = r["enrollment"].cast("string"), r["status"], policy.STUDY_ISSUES
    number = enrolled.try_cast("double")
    return F.array_compact(
        F.array(
            F.when(_missing(r["identifier"][0]["value"]), says["identifier"]),
            F.when(_missing(r["title"]), says["title"]),
            F.when(status.isNull(), F.format_string(says["no_status"], r["sourceStatus"])).when(
                ~status.isin(*policy.STUDY_STATUSES), F.format_string(says["status"], status)
            ),
            F.when(number < 0, says["negative"]).when(enrolled.isNotNull() & number.isNull(), F.format_string(says["number"], enrolled)),
        )
    )


def validated(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with resource_type, resource and issues; ``kind`` is Patient or ResearchStudy."""
    build, check = {"Patient": (patient_resource, patient_issues), "ResearchStudy": (study_resource, study_issues)}[kind]
    return (
        df.withColumn("resource", build()).withColumn("issues", check(F.col("resource"))).withColumn("resource_type", F.lit(kind))
    )


def issue_table(checked: DataFrame, key: str) -> DataFrame:
    """(key, position, issue) for failing rows; a missing key is ``<unknown>``. Rows are kept apart even if they share a key."""
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("<unknown>"))
    return exploded(checked.select(name.alias("key"), "issues"), "issues", "position", "issue").select("key", "position", "issue")


def conformance_report(checked: DataFrame) -> DataFrame:
    """One row for each resource type: validated, conformant, non_conformant, issue_count."""
    n = F.size("issues")
    return checked.groupBy("resource_type").agg(
        F.count("*").alias("resources_validated"),
        F.count_if(n == 0).alias("conformant"),
        F.count_if(n > 0).alias("non_conformant"),
        F.sum(n).cast("long").alias("issue_count"),
    )
