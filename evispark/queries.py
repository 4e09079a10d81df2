"""Queries over the driver tables, one or more for each operator, and what DuckDB runs for the same rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import policy
from .functions.phi import redact_phi, scan_phi
from .functions.splitting import OVERLAP, SEPARATORS, SIZE, split_text, with_overlap
from .functions.text import exploded, parse_age_years, tokenize
from .functions.vectors import encode_with, hash_embed
from .jobs.workloads import Feed, Index, answer, build_index, candidates, govern, ingest, load_governed
from .operators import chunking, fhir, flatten, governance, index, lists, quality, retrieval
from .operators.answers import rag_triad
from .scratch import new_path, scratch
from .sources.files import land_raw, quarantine, read_articles_xml, read_patients, read_quarantine, read_studies
from .sources.journal import Audit, Lineage, ancestry, chain_text, closure, table_versions, tail, trace
from .sources.versions import SchemaEnforcementError, VersionedTable, incremental_load, normalise_for_commit
from .streaming import events as ev
from .views import ARTICLES, AS_OF, NOTES, PATIENTS, TRIALS, articles, notes, patients, table, trials

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


# --- quality gate ------------------------------------------------------------------------------------------------------
_BLANK = r"NOT coalesce(regexp_matches({0}, '\S'), false)"
_STATUSES = ", ".join(f"'{s}'" for s in policy.TRIAL_STATUSES)
_ANY_TYPE = " OR ".join(f"contains(lower(coalesce(publication_types, '')), '{t}')" for t in policy.EVIDENCE_TYPES)
_GRADED_T = rf"""
WITH t AS ({TRIALS}), f AS (SELECT nct_id AS k, min(seq) AS first FROM t GROUP BY nct_id),
m AS (
  SELECT t.*,
    nct_id IS NULL OR {_BLANK.format("brief_title")} AS m1,
    {_BLANK.format("brief_summary")} AS m2,
    NOT regexp_matches(coalesce(nct_id, ''), '{policy.NCT_ID}') AS m3,
    seq > f.first AS m4,
    coalesce(min_age_years < 0, false) OR coalesce(min_age_years > 120, false) OR coalesce(max_age_years < 0, false)
      OR coalesce(max_age_years > 120, false) OR coalesce(min_age_years > max_age_years, false) OR coalesce(enrollment < 0, false) AS m5,
    upper(coalesce(overall_status, '')) NOT IN ({_STATUSES}) AS m6,
    coalesce(coalesce(try_strptime(last_update, '%Y-%m-%d'), try_strptime(last_update, '%Y-%m'))::DATE
      < DATE '{AS_OF}' - 1825, false) AS m7
  FROM t JOIN f ON t.nct_id IS NOT DISTINCT FROM f.k),
g AS (
  SELECT *, concat_ws('|', CASE WHEN m1 THEN 'MISSING_IDENTITY' END, CASE WHEN m3 THEN 'INVALID_NCT_ID' END,
      CASE WHEN m4 THEN 'DUPLICATE_NCT_ID' END, CASE WHEN m5 THEN 'IMPOSSIBLE_NUMERIC_VALUE' END) AS quality_failures,
    concat_ws('|', CASE WHEN m2 THEN 'MISSING_SUMMARY' END, CASE WHEN m6 THEN 'UNKNOWN_STATUS_VALUE' END,
      CASE WHEN m7 THEN 'STALE_RECORD' END) AS data_quality_flags
  FROM m)
"""
_GRADED_L = rf"""
WITH t AS ({ARTICLES}), f AS (SELECT pmid AS k, min(seq) AS first FROM t GROUP BY pmid),
m AS (
  SELECT t.*,
    pmid IS NULL OR {_BLANK.format("title")} AS m1,
    {_BLANK.format("abstract")} AS m2,
    NOT regexp_matches(coalesce(pmid, ''), '{policy.PMID}') AS m3,
    seq > f.first AS m4,
    coalesce(pub_year < 1800 OR pub_year > 2027, false) AS m5,
    NOT ({_ANY_TYPE}) AS m6,
    coalesce(pub_year < 2016, false) AS m7
  FROM t JOIN f ON t.pmid IS NOT DISTINCT FROM f.k),
g AS (
  SELECT *, concat_ws('|', CASE WHEN m1 THEN 'MISSING_IDENTITY' END, CASE WHEN m3 THEN 'INVALID_PMID' END,
      CASE WHEN m4 THEN 'DUPLICATE_PMID' END, CASE WHEN m5 THEN 'IMPOSSIBLE_PUBLICATION_YEAR' END) AS quality_failures,
    concat_ws('|', CASE WHEN m2 THEN 'MISSING_ABSTRACT' END, CASE WHEN m6 THEN 'UNRECOGNISED_PUBLICATION_TYPE' END,
      CASE WHEN m7 THEN 'DATED_EVIDENCE' END) AS data_quality_flags
  FROM m)
"""
_VERDICT = """
SELECT count(*) AS evaluated, count(*) FILTER (quality_failures <> '') AS rejected, count(*) FILTER (quality_failures = '') AS clean,
  count(*) FILTER (quality_failures = '' AND data_quality_flags <> '') AS advisory_flagged,
  round_even(count(*) FILTER (quality_failures <> '') / count(*), 4) AS fatal_ratio,
  count(*) FILTER (quality_failures <> '' OR data_quality_flags <> '') = 0 AS passed_all_gates,
  count(*) FILTER (quality_failures <> '') / count(*) > 0.3 AS halt_pipeline FROM g"""


def _report_sql(checks: list[quality.Check]) -> str:
    rows = [
        f"SELECT '{c.name}' AS metric, count(*) FILTER (m{i}) AS violations, '{c.severity}' AS severity,"
        f" CASE WHEN count(*) FILTER (m{i}) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM g"
        for i, c in enumerate(checks, 1)
    ]
    return " UNION ALL ".join(rows)


def _names(*checks: tuple[str, str]) -> list[quality.Check]:
    return [quality.Check(n, "", s, None) for n, s in checks]


_T_CHECKS = _names(
    *(("completeness_identity", "FATAL"), ("completeness_summary", "ADVISORY"), ("validity_nct_id_format", "FATAL"), ("uniqueness_nct_id", "FATAL")),
    *(("accuracy_numeric_ranges", "FATAL"), ("consistency_status_vocabulary", "ADVISORY"), ("timeliness_last_update", "ADVISORY")),
)
_L_CHECKS = _names(
    *(("completeness_identity", "FATAL"), ("completeness_abstract", "ADVISORY"), ("validity_pmid_format", "FATAL"), ("uniqueness_pmid", "FATAL")),
    *(("accuracy_publication_year", "FATAL"), ("consistency_publication_type", "ADVISORY"), ("timeliness_publication_year", "ADVISORY")),
)


def graded_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(trials(spark, sf_dir), quality.trial_gate(AS_OF))


def graded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(articles(spark, sf_dir), quality.literature_gate(2026))


@query(_GRADED_T + "SELECT seq, nct_id, quality_failures, data_quality_flags FROM g")
def quality_trials_graded(spark, sf_dir):
    return graded_trials(spark, sf_dir).select("seq", "nct_id", "quality_failures", "data_quality_flags")


@query(_GRADED_T + _report_sql(_T_CHECKS))
def quality_trials_report(spark, sf_dir):
    return quality.report(graded_trials(spark, sf_dir), quality.trial_gate(AS_OF))


@query(_GRADED_T + _VERDICT)
def quality_trials_verdict(spark, sf_dir):
    return quality.verdict(graded_trials(spark, sf_dir))


@query(_GRADED_T + "SELECT coalesce(overall_status, '') AS status, count(*) AS trials, count(*) FILTER (data_quality_flags <> '') AS flagged FROM g WHERE quality_failures = '' GROUP BY 1")
def quality_trials_clean(spark, sf_dir):
    clean = quality.clean_rows(graded_trials(spark, sf_dir))
    return clean.groupBy(F.coalesce("overall_status", F.lit("")).alias("status")).agg(
        F.count("*").alias("trials"), F.count_if(F.col("data_quality_flags") != "").alias("flagged")
    )


@query(_GRADED_T + "SELECT seq, nct_id, brief_title, quality_failures FROM g WHERE quality_failures <> ''")
def quality_trials_rejected(spark, sf_dir):
    return quality.rejected_rows(graded_trials(spark, sf_dir)).select("seq", "nct_id", "brief_title", "quality_failures")


@query(_GRADED_L + "SELECT seq, pmid, quality_failures, data_quality_flags FROM g")
def quality_literature_graded(spark, sf_dir):
    return graded_articles(spark, sf_dir).select("seq", "pmid", "quality_failures", "data_quality_flags")


@query(_GRADED_L + _report_sql(_L_CHECKS))
def quality_literature_report(spark, sf_dir):
    return quality.report(graded_articles(spark, sf_dir), quality.literature_gate(2026))


@query(_GRADED_L + _VERDICT)
def quality_literature_verdict(spark, sf_dir):
    return quality.verdict(graded_articles(spark, sf_dir))


# --- FHIR --------------------------------------------------------------------------------------------------------------
_MAP = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in policy.STUDY_STATUS_OF.items())
_STUDY_ISSUES = rf"""
WITH t AS ({TRIALS}), s AS (SELECT *, CASE upper(coalesce(overall_status, '')) {_MAP} END AS st FROM t),
i AS (
  SELECT seq, nct_id, list_filter([
    CASE WHEN coalesce(nct_id, '') = '' THEN 'ResearchStudy.identifier is required and must carry a value' END,
    CASE WHEN coalesce(brief_title, '') = '' THEN 'ResearchStudy.title is required for a citable study' END,
    CASE WHEN st IS NULL THEN 'ResearchStudy.status could not be derived from registry status ''' || upper(coalesce(overall_status, ''))
      || ''' - no mapping into the FHIR value set' END,
    CASE WHEN enrollment < 0 THEN 'ResearchStudy.enrollment must not be negative' END], lambda x: x IS NOT NULL) AS issues FROM s)
"""
_PATIENT_ISSUES = rf"""
WITH t AS ({PATIENTS}),
i AS (
  SELECT seq, medical_record_number, list_filter([
    CASE WHEN coalesce(medical_record_number, '') = '' THEN 'Patient.identifier is required (1..*) and must carry a value' END,
    CASE WHEN {_BLANK.format("patient_name")} THEN 'Patient.name.family is required for an official name' END,
    CASE WHEN gender NOT IN ('male', 'female', 'other', 'unknown') THEN 'Patient.gender ''' || gender
      || ''' is outside the bound value set administrative-gender (female|male|other|unknown)' END,
    CASE WHEN NOT regexp_matches(date_of_birth, '{policy.FHIR_DATE}') THEN 'Patient.birthDate ''' || date_of_birth || ''' is not a valid FHIR date' END,
    CASE WHEN email <> '' AND NOT regexp_matches(email, '{policy.EMAIL_ADDRESS}') THEN 'Patient.telecom(email) ''' || email || ''' is not a valid address' END
    ], lambda x: x IS NOT NULL) AS issues FROM t)
"""
_ISSUE_ROWS = "SELECT coalesce(nullif({0}, ''), '<unknown>') AS key, (unnest(range(len(issues))))::INT AS position, unnest(issues) AS issue FROM i WHERE len(issues) > 0"
_CONFORMANCE = "SELECT '{0}' AS resource_type, count(*) AS resources_validated, count(*) FILTER (len(issues) = 0) AS conformant, count(*) FILTER (len(issues) > 0) AS non_conformant, sum(len(issues))::BIGINT AS issue_count FROM i"


@query(_STUDY_ISSUES + _ISSUE_ROWS.format("nct_id"))
def fhir_study_issues(spark, sf_dir):
    return fhir.issue_table(fhir.validated(trials(spark, sf_dir), "ResearchStudy"), "nct_id")


@query(_PATIENT_ISSUES + _ISSUE_ROWS.format("medical_record_number"))
def fhir_patient_issues(spark, sf_dir):
    return fhir.issue_table(fhir.validated(patients(spark, sf_dir), "Patient"), "medical_record_number")


@query(_STUDY_ISSUES + _CONFORMANCE.format("ResearchStudy"))
def fhir_study_report(spark, sf_dir):
    return fhir.conformance_report(fhir.validated(trials(spark, sf_dir), "ResearchStudy"))


@query(_PATIENT_ISSUES + _CONFORMANCE.format("Patient"))
def fhir_patient_report(spark, sf_dir):
    return fhir.conformance_report(fhir.validated(patients(spark, sf_dir), "Patient"))


@query(
    rf"""WITH t AS ({TRIALS}) SELECT seq, nct_id AS identifier, CASE upper(coalesce(overall_status, '')) {_MAP} END AS status,
    coalesce(nullif(phase, ''), 'N/A') AS phase, CASE WHEN conditions = '' THEN 0 ELSE len(string_split(conditions, ';')) END::INT AS n_conditions,
    coalesce(trim(string_split(conditions, ';')[-1]), '') AS last_condition, sponsor FROM t"""
)
def fhir_study_resource(spark, sf_dir):
    r = trials(spark, sf_dir).select("seq", fhir.study_resource().alias("r"))
    return r.select(
        "seq",
        F.col("r.identifier")[0]["value"].alias("identifier"),
        "r.status",
        "r.phase.text",
        F.size("r.condition").alias("n_conditions"),
        F.coalesce(F.try_element_at("r.condition", F.lit(-1))["text"], F.lit("")).alias("last_condition"),
        "r.sponsor.display",
    ).toDF("seq", "identifier", "status", "phase", "n_conditions", "last_condition", "sponsor")


@query(
    rf"""WITH t AS ({PATIENTS}) SELECT seq, medical_record_number AS identifier, nullif(string_split(patient_name, ' ')[-1], '') AS family,
    CASE WHEN patient_name <> '' THEN string_split(patient_name, ' ')[1] END AS given, phone, email, gender, date_of_birth AS birth_date, address FROM t"""
)
def fhir_patient_resource(spark, sf_dir):
    r = patients(spark, sf_dir).select("seq", fhir.patient_resource().alias("r"))
    return r.select(
        "seq",
        F.col("r.identifier")[0]["value"].alias("identifier"),
        F.col("r.name")[0]["family"].alias("family"),
        F.array_join(F.col("r.name")[0]["given"], " ").alias("given"),
        F.col("r.telecom")[0]["value"].alias("phone"),
        F.col("r.telecom")[1]["value"].alias("email"),
        F.col("r.gender").alias("gender"),
        F.col("r.birthDate").alias("birth_date"),
        F.col("r.address")[0]["text"].alias("address"),
    )


# --- flattening --------------------------------------------------------------------------------------------------------
_AGE = "CAST(doc_id % 90 AS STRING) || CASE doc_id % 5 WHEN 0 THEN ' Years' WHEN 1 THEN ' Months' WHEN 2 THEN ' weeks' WHEN 3 THEN ' DAYS' ELSE ' eons' END"
_AGE_SQL = "CASE doc_id % 5 WHEN 4 THEN NULL ELSE round_even((doc_id % 90) * CASE doc_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE / 12 WHEN 2 THEN 1.0::DOUBLE / 52 ELSE 1.0::DOUBLE / 365 END, 2) END"


@query(f"SELECT doc_id, {_AGE} AS age, {_AGE_SQL} AS years FROM documents")
def age_parse(spark, sf_dir):
    aged = table(spark, sf_dir, "documents").select("doc_id", F.expr(_AGE).alias("age"))
    return aged.withColumn("years", parse_age_years(F.col("age")))


def nested_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials as the registry nests them."""
    t = trials(spark, sf_dir)
    s = lambda **x: F.struct(*[c.alias(n) for n, c in x.items()])
    parts = lambda c: F.when(F.col(c) != "", F.split(c, "; "))
    years = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("int").cast("string"), F.lit(" Years")))
    drug = lambda i: s(type=F.lit("DRUG"), name=F.concat(F.lit(f"agent {i} "), F.col("sponsor")))
    place = s(city=F.concat(F.lit("Town "), F.col("sponsor")), state=F.lit(None).cast("string"), country=F.lit("Freeland"))
    return t.select(
        "seq",
        s(
            identificationModule=s(nctId=F.col("nct_id"), briefTitle=F.col("brief_title")),
            statusModule=s(overallStatus=F.col("overall_status"), lastUpdatePostDateStruct=s(date=F.col("last_update"))),
            descriptionModule=s(briefSummary=F.col("brief_summary")),
            conditionsModule=s(conditions=parts("conditions")),
            designModule=s(studyType=F.col("study_type"), phases=parts("phase"), enrollmentInfo=s(count=F.col("enrollment").cast("long"))),
            eligibilityModule=s(
                eligibilityCriteria=F.col("eligibility_criteria"),
                minimumAge=years("min_age_years"),
                maximumAge=years("max_age_years"),
                sex=F.col("sex"),
                healthyVolunteers=F.col("healthy_volunteers"),
            ),
            armsInterventionsModule=s(interventions=F.array(*[drug(i) for i in range(1, 8)])),
            contactsLocationsModule=s(locations=F.array(place, place)),
            sponsorCollaboratorsModule=s(leadSponsor=s(name=F.col("sponsor"))),
        ).alias("protocolSection"),
    )


_DRUGS = " || '; ' || ".join(f"'DRUG: agent {i} ' || sponsor" for i in range(1, 7))


@query(
    rf"""WITH t AS ({TRIALS}) SELECT seq, nct_id, brief_title, overall_status, last_update, brief_summary, conditions, study_type, phase, enrollment,
    eligibility_criteria, min_age_years, max_age_years, sex, healthy_volunteers, {_DRUGS} AS interventions,
    'Town ' || sponsor || ', Freeland' AS locations, sponsor, 'https://clinicaltrials.gov/study/' || coalesce(nct_id, '') AS source_url FROM t"""
)
def flatten_studies(spark, sf_dir):
    return flatten.flatten_studies(nested_studies(spark, sf_dir), keep=("seq",))


def _tag(name: str, c: Column, attributes: str = "") -> Column:
    escaped = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), escaped, F.lit(f"</{name}>")), F.lit(""))


def article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as the literature service's XML; control characters, which XML can't hold, become spaces."""
    a = articles(spark, sf_dir)
    clean = lambda c: F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]", " ")
    body = F.when(F.col("abstract").isNotNull(), F.concat(_tag("AbstractText", F.lit("all of it"), ' Label="SUMMARY"'), _tag("AbstractText", clean(F.col("abstract")))))
    kinds = F.array_join(F.transform(F.split("publication_types", "; "), lambda k: F.concat(F.lit("<PublicationType>"), k, F.lit("</PublicationType>"))), "")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation>"),
        _tag("PMID", F.col("pmid")),
        F.lit("<Article>"),
        _tag("ArticleTitle", clean(F.col("title"))),
        F.coalesce(F.concat(F.lit("<Abstract>"), body, F.lit("</Abstract>")), F.lit("")),
        F.lit("<Journal>"),
        _tag("Title", F.col("journal")),
        F.lit("<JournalIssue><PubDate>"),
        F.when(F.col("seq") % 2 == 0, _tag("Year", F.col("pub_year").cast("string"))).otherwise(
            _tag("MedlineDate", F.concat(F.col("pub_year").cast("string"), F.lit(" Jan-Feb")))
        ),
        F.lit("</PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author>"),
        F.lit("<Author><Initials>X</Initials></Author></AuthorList><PublicationTypeList>"),
        kinds,
        F.lit("</PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList>"),
        _tag("ArticleId", F.lit("10.1/first"), ' IdType="doi"'),
        _tag("ArticleId", F.col("doi"), ' IdType="doi"'),
        F.lit("</ArticleIdList></PubmedData></PubmedArticle>"),
    )
    return a.select("seq", xml.alias("xml"))


_CLEAN = r"trim(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\r]', ' ', 'g'), E' \t\n')"


@query(
    rf"""WITH t AS ({ARTICLES}) SELECT seq, pmid, {_CLEAN.format("title")} AS title,
    CASE WHEN abstract IS NOT NULL THEN 'SUMMARY: all of it' || chr(10) || {_CLEAN.format("abstract")} END AS abstract, journal, pub_year::VARCHAR AS pub_year, 'Doe J' AS authors,
    publication_types, doi, CASE WHEN pmid IS NOT NULL THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS source_url FROM t"""
)
def flatten_articles(spark, sf_dir):
    return flatten.flatten_articles(article_xml(spark, sf_dir), keep=("seq",)).withColumn("pub_year", F.col("pub_year").cast("string"))


@query(f"WITH t AS ({ARTICLES}) SELECT seq, seq % 7 = 0 OR seq % 11 = 0 AS unread FROM t")
def unread_articles(spark, sf_dir):
    """Fragments that are cut short, that have a document type, or the words of one in a title: which of them are read."""
    a = article_xml(spark, sf_dir)
    quoted = F.replace(F.col("xml"), F.lit("<ArticleTitle>"), F.lit("<ArticleTitle><![CDATA[<!DOCTYPE x>]]>"))
    xml = F.when(F.col("seq") % 7 == 0, F.expr("substr(xml, 1, length(xml) - 9)")).when(F.col("seq") % 11 == 0, F.concat(F.lit("<?xml version='1.0'?> <!DOCTYPE x>"), "xml")).otherwise(quoted)
    seeded = a.withColumn("xml", xml)
    read = flatten.flatten_articles(seeded, keep=("seq",)).select("seq", F.lit(False).alias("unread"))
    return read.unionAll(flatten.unread_articles(seeded).select("seq", F.lit(True).alias("unread")))


@query(f"WITH t AS ({TRIALS}) SELECT seq, nct_id, brief_title FROM t WHERE nct_id IS NOT NULL AND nct_id <> ''")
def trials_with_id(spark, sf_dir):
    return flatten.with_identifier(trials(spark, sf_dir), "nct_id").select("seq", "nct_id", "brief_title")


# --- landing zone ------------------------------------------------------------------------------------------------------
@query(
    rf"""WITH t AS ({TRIALS}) SELECT nct_id, brief_title, overall_status, brief_summary, eligibility_criteria, min_age_years, {_DRUGS} AS interventions,
    sponsor, count(*) AS records FROM t GROUP BY ALL"""
)
def landed_studies(spark, sf_dir):
    """Studies landed as JSON lines, read back and flattened."""
    at = new_path(spark, "landing")
    land_raw(nested_studies(spark, sf_dir).drop("seq"), at)
    back = flatten.flatten_studies(read_studies(spark, at))
    columns = ["nct_id", "brief_title", "overall_status", "brief_summary", "eligibility_criteria", "min_age_years", "interventions", "sponsor"]
    return back.groupBy(*columns).agg(F.count("*").alias("records"))


@query(
    rf"""WITH t AS ({ARTICLES}) SELECT pmid, {_CLEAN.format("title")} AS title,
    CASE WHEN abstract IS NOT NULL THEN 'SUMMARY: all of it' || chr(10) || {_CLEAN.format("abstract")} END AS abstract, doi, count(*) AS records FROM t GROUP BY ALL"""
)
def landed_articles(spark, sf_dir):
    """Articles landed as XML text, read back fragment by fragment and flattened."""
    at = new_path(spark, "landing")
    land_raw(article_xml(spark, sf_dir).select("xml"), at)
    back = flatten.flatten_articles(read_articles_xml(spark, at))
    return back.groupBy("pmid", "title", "abstract", "doi").agg(F.count("*").alias("records"))


@query(f"WITH t AS ({PATIENTS}) SELECT * EXCLUDE (seq, hba1c), round(hba1c, 6) AS hba1c FROM t")
def landed_patients(spark, sf_dir):
    at = new_path(spark, "landing")
    land_raw(patients(spark, sf_dir).drop("seq"), at)
    return read_patients(spark, at, "json").withColumn("hba1c", F.round("hba1c", 6))


@query(_GRADED_T + "SELECT seq::STRING AS seq, nct_id, quality_failures FROM g WHERE quality_failures <> ''")
def quarantined_trials(spark, sf_dir):
    """Rejected trials written to quarantine as CSV and read back."""
    rejected = quality.rejected_rows(graded_trials(spark, sf_dir))
    at = quarantine(rejected, "trials", new_path(spark, "quarantine"), AS_OF, rejected.count())
    return read_quarantine(spark, at).select("seq", "nct_id", "quality_failures")


@query("SELECT c_custkey, c_acctbal AS balance, NULL::DOUBLE AS name, c_nationkey::STRING AS nation FROM customer")
def normalised_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select("c_custkey", F.col("c_acctbal").cast("string").alias("balance"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"))
    return normalise_for_commit(raw, ["balance", "name"])


# --- governance --------------------------------------------------------------------------------------------------------
def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_SCAN = " UNION ALL ".join(f"SELECT note_id, '{k}' AS type, unnest(regexp_extract_all(text, {_quoted(p)})) AS value FROM n" for k, p in policy.PHI_PATTERNS.items())


def _redact_sql(text: str) -> str:
    for k, p in policy.PHI_PATTERNS.items():
        text = f"regexp_replace({text}, {_quoted(p)}, '[REDACTED_{k}]', 'g')"
    return text


_GATED = " OR ".join(f"regexp_matches(text, {_quoted(policy.PHI_PATTERNS[k])})" for k in policy.GATED_FAMILIES)
_GATED_LIST = ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(policy.PHI_PATTERNS[k])}) THEN '{k}' END" for k in sorted(policy.GATED_FAMILIES))


@query(f"WITH n AS ({NOTES}) SELECT note_id, type, value FROM ({_SCAN})")
def phi_scan(spark, sf_dir):
    return governance.phi_findings(notes(spark, sf_dir), "note_id", "text")


@query(f"WITH n AS ({NOTES}) SELECT type, count(*) AS hits FROM ({_SCAN}) GROUP BY type")
def phi_summary(spark, sf_dir):
    return governance.phi_summary(governance.phi_findings(notes(spark, sf_dir), "note_id", "text"))


@query(f"WITH n AS ({NOTES}) SELECT note_id, {_redact_sql('text')} AS redacted FROM n")
def phi_redact(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", redact_phi(F.col("text")).alias("redacted"))


@query(f"SELECT event_id, {_redact_sql('props')} AS redacted, len(regexp_extract_all(props, {_quoted(policy.PHI_PATTERNS['PHONE'])}))::INT AS phones FROM events")
def phi_events(spark, sf_dir):
    hits = F.size(F.filter(scan_phi(F.col("props")), lambda h: h["type"] == "PHONE"))
    return table(spark, sf_dir, "events").select("event_id", redact_phi(F.col("props")).alias("redacted"), hits.alias("phones"))


@query(f"WITH n AS ({NOTES}) SELECT note_id FROM n WHERE NOT ({_GATED})")
def phi_gate_admitted(spark, sf_dir):
    return governance.phi_gate(notes(spark, sf_dir))[0].select("note_id")


@query(f"WITH n AS ({NOTES}) SELECT note_id, concat_ws(',', {_GATED_LIST}) AS phi_types FROM n WHERE {_GATED}")
def phi_gate_blocked(spark, sf_dir):
    blocked = governance.phi_gate(notes(spark, sf_dir))[1]
    return governance.blocked_report(blocked, "note_id").select("note_id", F.array_join("phi_types", ",").alias("phi_types"))


@query(
    f"""SELECT item_id AS query_id, {_redact_sql("text")} AS query_redacted, substr(sha256(text), 1, 16) AS query_hash,
    concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(text, {_quoted(policy.PHI_PATTERNS[k])}) THEN '{k}' END" for k in sorted(policy.PHI_PATTERNS))}) AS phi_stripped
    FROM benchmark"""
)
def redact_queries(spark, sf_dir):
    out = governance.redact_queries(questions(spark, sf_dir))
    return out.select("query_id", "query_redacted", "query_hash", F.array_join("phi_stripped", ",").alias("phi_stripped"))


SALT = "a-salt-for-tests"


@query(
    f"""WITH t AS ({PATIENTS}) SELECT seq, gender, age_years, {_redact_sql("diagnosis")} AS diagnosis, hba1c, comorbidities,
    'PATIENT_' || upper(substr(sha256('{SALT}' || coalesce(nullif(medical_record_number, ''), nullif(patient_name, ''))), 1, 10)) AS patient_pseudonym FROM t"""
)
def deidentify(spark, sf_dir):
    return governance.deidentify(patients(spark, sf_dir), SALT)[0]


_FIELD_HITS = " UNION ALL ".join(f"SELECT 'FIELD:{c}' AS type FROM t WHERE {c} IS NOT NULL" for c in policy.RESTRICTED_FIELDS)
_TEXT_HITS = " UNION ALL ".join(
    f"SELECT '{k}' AS type FROM (SELECT unnest(regexp_extract_all({c}, {_quoted(p)})) FROM t)"
    for c in ("gender", "diagnosis", "comorbidities")
    for k, p in policy.PHI_PATTERNS.items()
)


@query(f"WITH t AS ({PATIENTS}) SELECT type, count(*) AS hits FROM ({_FIELD_HITS} UNION ALL {_TEXT_HITS}) GROUP BY type")
def deidentify_summary(spark, sf_dir):
    return governance.phi_summary(governance.deidentify(patients(spark, sf_dir), SALT)[1])


_PATIENT_COLUMNS = "patient_name medical_record_number date_of_birth phone email address gender age_years diagnosis hba1c comorbidities".split()


def _mask_sql() -> str:
    columns = []
    for c in _PATIENT_COLUMNS:
        readers = [f"'{r}'" for r, classes in policy.ROLE_CLASSES.items() if policy.FIELD_CLASS[c] in classes]
        text = f"{c}::STRING"
        columns.append(f"CASE WHEN role IN ({', '.join(readers)}) THEN {text} ELSE '***MASKED[{policy.FIELD_CLASS[c]}]***' END AS {c}" if readers else f"'***MASKED[{policy.FIELD_CLASS[c]}]***' AS {c}")
    roles = ", ".join(f"'{r}'" for r in policy.ROLE_CLASSES)
    return f"WITH t AS ({PATIENTS}), r AS (SELECT unnest([{roles}]) AS role) SELECT role, seq, {', '.join(columns)} FROM t, r"


@query(_mask_sql().replace("hba1c::STRING", "round(hba1c, 3)::DECIMAL(18, 3)::STRING"))
def mask_by_role(spark, sf_dir):
    thousandths = F.round(F.col("hba1c") * 1000, 0)  # SQL rounds the product, whose ties are not those of the decimal text
    held = patients(spark, sf_dir).withColumn("hba1c", (thousandths / 1000).cast("decimal(18,3)"))
    return governance.masked_for_roles(held, "seq", list(policy.ROLE_CLASSES))


@query(
    f"""WITH t AS ({PATIENTS}), """
    + "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, '{policy.FIELD_CLASS[c]}' AS class, count({c}) AS filled FROM t" for c in _PATIENT_COLUMNS) + ")"
    + " SELECT field, class, filled FROM c UNION ALL SELECT 'seq', 'CONFIDENTIAL', count(seq) FROM t"
)
def classified_fields(spark, sf_dir):
    """The class of each patient column, with how many rows fill it."""
    p = patients(spark, sf_dir)
    filled = p.agg(F.array(*[F.struct(F.lit(c).alias("field"), F.count(c).alias("filled")) for c in p.columns]).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return governance.classify(p).join(filled, "field")


# --- chunks ------------------------------------------------------------------------------------------------------------
_T_HEADER = "'Trial ' || coalesce(nct_id, '') || ' - ' || coalesce(brief_title, '') || chr(10) || 'Status: ' || coalesce(overall_status, '') || ' | Phase: ' || coalesce(nullif(phase, ''), 'N/A') || ' | Conditions: ' || coalesce(conditions, '') || chr(10)"
_L_HEADER = "'Article PMID ' || coalesce(pmid, '') || ' - ' || coalesce(title, '') || chr(10) || coalesce(nullif(journal, ''), 'Unknown journal') || ' (' || coalesce(pub_year::STRING, 'n.d.') || ') | ' || coalesce(nullif(publication_types, ''), 'Journal Article') || chr(10)"
_CITATION = "coalesce(nullif(authors, ''), 'Unknown authors') || '. ' || coalesce(title, '') || '. ' || coalesce(journal, '') || ' ' || coalesce(pub_year::STRING, '') || '. doi:' || coalesce(nullif(doi, ''), 'n/a')"
_SPACES = "E' \\t\\n\\r\\x0b\\x0c'"
_SHORT = "length({0}) <= 900 AND regexp_matches({0}, '\\S')"




def _split_sql(text: str, size: int = SIZE) -> str:
    """A list of pieces: for one separator after another, parts of what is too long are put together as long as they fit."""
    none = "[]::VARCHAR[]"
    pieces = f"[{text}]"
    for separator in SEPARATORS:
        by = "'" + separator.replace("\n", "' || chr(10) || '") + "'"
        parts = f"list_prepend({{'done': {none}, 'now': ''}}, list_transform(string_split(p, {by}), lambda x: {{'done': {none}, 'now': x}}))"
        fold = (
            f"list_reduce({parts}, lambda a, b: CASE WHEN length(a.now) = 0 THEN {{'done': a.done, 'now': b.now}}"
            f" WHEN length(a.now) + length(b.now) + {len(separator)} <= {size} THEN {{'done': a.done, 'now': a.now || {by} || b.now}}"
            " ELSE {'done': list_append(a.done, a.now), 'now': b.now} END)"
        )
        ended = f"list_transform([{fold}], lambda s: CASE WHEN length(s.now) > 0 THEN list_append(s.done, s.now) ELSE s.done END)[1]"
        pieces = f"flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) > {size} THEN {ended} ELSE [p] END))"
    return pieces


def _sections_sql(source: str, record: str, header: str, sections: dict[str, str], kind: str) -> str:
    """Chunks (source_type, key, section, chunk_index, text) of the rows of a common table."""
    key = f"coalesce({record}, '{chunking.UNNAMED}' || substr(md5(concat_ws(chr(31), {header}, {', '.join(f"coalesce({b}, '')" for b in sections.values())})), 1, 20))"
    each = " UNION ALL ".join(f"SELECT {key} AS key, {header} AS header, '{n}' AS section, {b} AS body FROM {source} WHERE regexp_matches({b}, '\\S')" for n, b in sections.items())
    strip = f"trim({{0}}, {_SPACES})"
    overlapped = "CASE WHEN i = 1 THEN ps[i] ELSE " + strip.format(f"right(ps[i - 1], {OVERLAP}) || ' ' || ps[i]") + " END"
    return f"""SELECT '{kind}' AS source_type, key, section, (i - 1)::INT AS chunk_index, {strip.format("header || '[' || upper(section) || '] ' || " + overlapped)} AS text
    FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT key, header, section, {_split_sql("body")} AS ps FROM ({each})))"""


_FACTS = " || ".join(
    [
        "'Eligible ages: ' || coalesce(regexp_replace(min_age_years::STRING, '\\.0$', ''), 'unspecified')",
        "' to ' || coalesce(regexp_replace(max_age_years::STRING, '\\.0$', ''), 'no upper limit')",
        "' years. Sex eligible: ' || coalesce(nullif(sex, ''), 'unspecified')",
        "'. Enrollment target: ' || coalesce(regexp_replace(enrollment::STRING, '\\.0$', ''), 'unspecified') || '.' || chr(10)",
    ]
)
_T_SECTIONS = {"summary": "brief_summary", "eligibility": f"({_FACTS} || coalesce(eligibility_criteria, ''))", "interventions": "interventions"}
_L_SECTIONS = {"abstract": "abstract", "citation": f"({_CITATION})"}


def _trial_chunks_sql(source: str) -> str:
    return _sections_sql(source, "nct_id", _T_HEADER, _T_SECTIONS, "trial")


def _article_chunks_sql(source: str) -> str:
    return _sections_sql(source, "'PMID' || pmid", _L_HEADER, _L_SECTIONS, "literature")


_CHUNK_ROWS = "SELECT key || '::' || section || '::' || chunk_index AS chunk_id, section, chunk_index, text FROM c"


@query(f"WITH t AS ({TRIALS}), c AS ({_trial_chunks_sql('t')}) {_CHUNK_ROWS}")
def chunk_trials(spark, sf_dir):
    return chunking.chunk_trials(trials(spark, sf_dir)).select("chunk_id", "section", "chunk_index", "text")


@query(f"WITH t AS ({ARTICLES}), c AS ({_article_chunks_sql('t')}) {_CHUNK_ROWS}")
def chunk_articles(spark, sf_dir):
    return chunking.chunk_articles(articles(spark, sf_dir)).select("chunk_id", "section", "chunk_index", "text")


@query(f"WITH t AS ({TRIALS}), l AS ({ARTICLES}), c AS ({_trial_chunks_sql('t')} UNION ALL {_article_chunks_sql('l')}) SELECT source_type, count(*) AS chunks FROM c GROUP BY 1")
def chunk_counts(spark, sf_dir):
    t = chunking.chunk_trials(trials(spark, sf_dir), chunking.TRIAL_FACTS[:-1])
    return chunking.chunk_counts(chunking.all_chunks(t, chunking.chunk_articles(articles(spark, sf_dir), chunking.ARTICLE_FACTS[:-1])))


@query(f"SELECT doc_id, (unnest(range(len(ps))))::INT AS position, unnest(ps) AS piece FROM (SELECT doc_id, {_split_sql('text', 300)} AS ps FROM documents)")
def split_pieces(spark, sf_dir):
    """Every piece of every text, at borders that most texts have."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", split_text(F.col("text"), 300).alias("p"))
    return exploded(pieces, "p", "position", "piece").drop("p")


@query(
    f"""SELECT doc_id, (unnest(range(len(ps))))::INT AS position, unnest(list_transform(ps, lambda x, i: CASE WHEN i = 1 THEN x ELSE trim(right(ps[i - 1], 40) || ' ' || x, {_SPACES}) END)) AS piece
    FROM (SELECT doc_id, {_split_sql("text", 300)} AS ps FROM documents)"""
)
def split_overlap(spark, sf_dir):
    """The same with an overlap of 40 characters."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", split_text(F.col("text"), 300).alias("p"))
    return exploded(pieces, with_overlap("p", 40), "position", "piece").drop("p")


@query(
    f"""WITH t AS ({TRIALS}) SELECT nct_id || '::interventions::0' AS chunk_id, 'Trial ' || nct_id || ' - ' || brief_title || chr(10) || 'Status: '
    || coalesce(overall_status, '') || ' | Phase: ' || coalesce(nullif(phase, ''), 'N/A') || ' | Conditions: ' || conditions || chr(10)
    || '[INTERVENTIONS] ' || interventions AS text FROM t WHERE nct_id IS NOT NULL"""
)
def chunk_interventions(spark, sf_dir):
    chunks = chunking.chunk_trials(trials(spark, sf_dir).filter("nct_id IS NOT NULL"))
    return chunks.filter("section = 'interventions'").select("chunk_id", "text")


@query(f"WITH t AS ({ARTICLES}) SELECT 'PMID' || pmid || '::citation::0' AS chunk_id, {_L_HEADER} || '[CITATION] ' || {_CITATION} AS text FROM t WHERE pmid IS NOT NULL AND length({_CITATION}) <= 900")
def chunk_citations(spark, sf_dir):
    chunks = chunking.chunk_articles(articles(spark, sf_dir).filter("pmid IS NOT NULL"))
    return chunks.filter("section = 'citation'").select("chunk_id", "text")


@query(
    f"""WITH t AS ({TRIALS}), l AS ({ARTICLES}), a AS (
    SELECT nct_id || '::summary::0' AS chunk_id, {_T_HEADER} || '[SUMMARY] ' || brief_summary AS text FROM t WHERE nct_id IS NOT NULL AND {_SHORT.format("brief_summary")}
    UNION ALL SELECT 'PMID' || pmid || '::abstract::0', {_L_HEADER} || '[ABSTRACT] ' || abstract FROM l WHERE pmid IS NOT NULL AND {_SHORT.format("abstract")})
    SELECT chunk_id, trim(text, {_SPACES}) AS text FROM a"""
)
def chunk_short_texts(spark, sf_dir):
    """Chunks of summaries and abstracts that are one piece."""
    t = chunking.chunk_trials(trials(spark, sf_dir).filter("nct_id IS NOT NULL AND length(brief_summary) <= 900"), ["nct_id"])
    a = chunking.chunk_articles(articles(spark, sf_dir).filter("pmid IS NOT NULL AND length(abstract) <= 900"), ["pmid"])
    return chunking.all_chunks(t, a).filter("section IN ('summary', 'abstract')").select("chunk_id", "text")


@query(
    f"""WITH t AS ({TRIALS}), l AS ({ARTICLES}), s AS (
    SELECT 'trial' AS source_type, 'summary' AS section FROM t WHERE regexp_matches(brief_summary, '\\S')
    UNION ALL SELECT 'trial', 'eligibility' FROM t UNION ALL SELECT 'trial', 'interventions' FROM t WHERE regexp_matches(interventions, '\\S')
    UNION ALL SELECT 'literature', 'abstract' FROM l WHERE regexp_matches(abstract, '\\S') UNION ALL SELECT 'literature', 'citation' FROM l)
    SELECT source_type, section, 'LIN_0002_EMBED' AS lineage_id, 'PUBLIC' AS classification, count(*) AS records FROM s GROUP BY ALL"""
)
def chunk_sections(spark, sf_dir):
    """Sections of both sources that have chunks, after they are put together and enriched; the first chunk of each counts."""
    t = chunking.chunk_trials(trials(spark, sf_dir), chunking.TRIAL_FACTS[:-1])
    every = chunking.enrich_chunks(chunking.all_chunks(t, chunking.chunk_articles(articles(spark, sf_dir), chunking.ARTICLE_FACTS[:-1])), "LIN_0002_EMBED")
    return every.filter("chunk_index = 0").groupBy("source_type", "section", "lineage_id", "classification").agg(F.count("*").alias("records"))


@query("SELECT doc_id, md5(regexp_replace(text, '[.\\s]', '', 'g')) AS letters, false AS oversize FROM documents")
def split_letters(spark, sf_dir):
    """Splitting loses nothing but separators, and no piece is too long."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", split_text(F.col("text")).alias("p"))
    return pieces.select("doc_id", F.md5(F.regexp_replace(F.array_join("p", ""), r"[.\s]", "")).alias("letters"), (F.array_max(F.transform("p", F.length)) > 900).alias("oversize"))


_CLEAN_T = "(" + _GRADED_T + "SELECT * FROM g WHERE quality_failures = '')"
_CLEAN_L = "(" + _GRADED_L + "SELECT * FROM g WHERE quality_failures = '')"


@query(
    f"""WITH t AS {_CLEAN_T}, l AS {_CLEAN_L}, c AS ({_trial_chunks_sql("t")} UNION ALL {_article_chunks_sql("l")})
    SELECT source_type, section, count(*) FILTER (NOT ({_GATED})) AS admitted, count(*) FILTER ({_GATED}) AS blocked, count(*) FILTER ({_GATED}) AS logged FROM c GROUP BY ALL"""
)
def index_job(spark, sf_dir):
    """The index job over the clean rows of both sources: chunks of each section that it admitted, blocked and noted in the audit."""
    at = new_path(spark, "index")
    t, a = quality.clean_rows(graded_trials(spark, sf_dir)), quality.clean_rows(graded_articles(spark, sf_dir))
    audit = Audit(spark, f"{at}/audit")
    built, blocked = build_index(t, a, f"{at}/index", ("LIN_0001_LAKEHOUSE_COMMIT", "LIN_0003_LAKEHOUSE_COMMIT"), audit=audit)
    section = F.split("chunk_id", "::")[1].alias("section")
    source = F.when(F.col("chunk_id").startswith("PMID"), "literature").otherwise("trial").alias("source_type")
    noted = audit.load().filter("action = 'VECTOR_INSERT_BLOCKED'").select(F.get_json_object("payload", "$.chunk_id").alias("chunk_id"))
    rows = [df.select(source, section, *(F.lit(int(i == k)).alias(n) for i, n in enumerate(("admitted", "blocked", "logged")))) for k, df in enumerate((built, blocked, noted))]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).groupBy("source_type", "section").agg(*(F.sum(n).alias(n) for n in ("admitted", "blocked", "logged")))


# --- tokens and vectors ------------------------------------------------------------------------------------------------
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_MD5_BUCKET = (
    "((('0x' || substr(md5(token), 1, 8))::BIGINT + ('0x' || substr(md5(token), 9, 8))::BIGINT + ('0x' || substr(md5(token), 17, 8))::BIGINT) * 256"
    " + ('0x' || substr(md5(token), 25, 8))::BIGINT) % 384"
)


def _vectors_sql(source: str, key: str, text: str) -> str:
    """CTE body (key, bucket, val) of hashed embeddings, in the float32 that the index keeps."""
    return f"""
    SELECT key, bucket, (w / sqrt(sum(w * w) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS val FROM (
      SELECT key, bucket, 1 + ln(count(*)) AS w FROM (
        SELECT key, {_MD5_BUCKET} AS bucket FROM (SELECT {key} AS key, unnest({_TOKENS.format(text)}) AS token FROM {source}))
      GROUP BY key, bucket)"""


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n_tokens, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_md5 FROM documents")
def tokens(spark, sf_dir):
    t = tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query(f"WITH v AS ({_vectors_sql('documents', 'doc_id', 'text')}) SELECT key AS doc_id, bucket, round(val, 6) AS weight FROM v")
def hash_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", hash_embed(F.col("text")).alias("v"))
    return exploded(v, "v", "bucket", "w").filter("w > 0").select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 6).alias("weight")
    )


@query("""SELECT query_id, vec_id, dense_score, dense_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, vec_id)::INT AS dense_rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS dense_score
    FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)) WHERE dense_rank <= 25""")
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")  # the searches' query set
    return retrieval.dense_topk(asked, vectors, 25, digits=6, key="vec_id")


@query(ORACLES["dense_topk"])
def dense_topk_lists(spark, sf_dir):
    """The same from inverted lists, of which those are read that can hold a hit."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    held = lists.ListIndex.write(vectors, new_path(spark, "lists"), "vec_id")
    asked = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return lists.list_topk(asked, held, 25, digits=6)


@query("SELECT count(*) AS chunks, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim FROM embeddings")
def index_stats(spark, sf_dir):
    return index.index_stats(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))


@query("SELECT vec_id::STRING AS vec_id, to_json(list_transform(embedding, lambda x: round(x::DOUBLE * 100)::INT)) AS embedding, coalesce(label::STRING, '') AS label FROM embeddings")
def sanitise_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int"))
    return index.sanitise_metadata(e.select("vec_id", whole.alias("embedding"), "label"))


# --- retrieval ---------------------------------------------------------------------------------------------------------
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def doc_index(spark: SparkSession, sf_dir: str) -> Index:
    """An index over documents, with the columns that evidence needs; its tables are written to scratch once."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.lit("literature").alias("source_type"),
        F.concat(F.lit("PMID"), F.col("doc_id").cast("string")).alias("record_id"),
        F.lit(None).cast("string").alias("nct_id"),
        F.lit("abstract").alias("section"),
        F.lit("LIN_0000_EMBED").alias("lineage_id"),
        F.col("source").alias("source_url"),
        F.lit("").alias("data_quality_flags"),
        F.lit("").alias("last_update"),
        F.lit(None).cast("double").alias("min_age_years"),
        "text",
    )
    chunks = index.ChunkStore(spark, new_path(spark, "chunks")).write(docs)
    vectors = scratch(index.embed(chunks.select("chunk_id", "text")).select("chunk_id", "vector"), "vectors")
    posted = scratch(index.postings(chunks), "postings")
    stats = scratch(index.posted_stats(posted), "stats")
    return Index(chunks, vectors, posted, scratch(index.term_stats(posted, stats.select("n")), "terms"), stats, index.index_stats(vectors))


_POSTED = f"""tok AS (SELECT doc_id AS chunk_id, {_TOKENS.format("text")} AS ts FROM documents),
posted AS (SELECT chunk_id, term, doc_len, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS doc_len, unnest(ts) AS term FROM tok) GROUP BY chunk_id, term, doc_len),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
raws AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM dfs, stats),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
_SPARSE = f"""qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS sparse_score
  FROM qt JOIN posted USING (term) JOIN idfs USING (term), stats GROUP BY query_id, chunk_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, chunk_id)::INT AS sparse_rank FROM sc WHERE sparse_score > 0)
  WHERE sparse_rank <= 25)"""
_DENSE = f"""qv AS ({_vectors_sql("benchmark", "item_id", "text")}), dv AS ({_vectors_sql("documents", "doc_id", "text")}),
dots AS (SELECT q.key AS query_id, d.key AS chunk_id, sum(q.val * d.val) AS s FROM qv q JOIN dv d USING (bucket) GROUP BY ALL),
pairs AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b, documents d),
qn AS (SELECT key, sqrt(sum(val * val)) AS n FROM qv GROUP BY key), dn AS (SELECT key, sqrt(sum(val * val)) AS n FROM dv GROUP BY key),
cs AS (SELECT p.query_id, p.chunk_id, round(coalesce(s / (qn.n * dn.n), 0), 6) AS dense_score FROM pairs p LEFT JOIN dots USING (query_id, chunk_id)
  LEFT JOIN qn ON qn.key = p.query_id LEFT JOIN dn ON dn.key = p.chunk_id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id)::INT AS dense_rank FROM cs) WHERE dense_rank <= 25)"""
_FUSED = """one AS (SELECT query_id, chunk_id, max(dense_rank) AS dense_rank, max(sparse_rank) AS sparse_rank FROM (
    SELECT query_id, chunk_id, dense_rank, NULL::INT AS sparse_rank FROM dense UNION ALL SELECT query_id, chunk_id, NULL, sparse_rank FROM sparse) GROUP BY ALL),
rrf AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS rrf_score,
    CASE WHEN sparse_rank IS NULL THEN 'dense' WHEN dense_rank IS NULL THEN 'sparse' ELSE 'hybrid' END AS retrieved_by FROM one),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id)::INT AS fused_rank FROM rrf)"""
_TOP = f"""qterm AS (SELECT DISTINCT query_id, term FROM qt),
qw AS (SELECT query_id, term, coalesce(ln(1 + n / (1 + df)), 1.0) AS weight FROM qterm LEFT JOIN dfs USING (term), stats),
tot AS (SELECT query_id, sum(weight) AS total FROM qw GROUP BY query_id),
hit AS (SELECT f.query_id, f.chunk_id, sum(w.weight) AS shared FROM fused f JOIN qw w USING (query_id) JOIN posted p ON p.chunk_id = f.chunk_id AND p.term = w.term GROUP BY ALL),
rr AS (SELECT f.*, round(coalesce(shared / total, 0), 6) AS rerank_score FROM fused f LEFT JOIN hit USING (query_id, chunk_id) LEFT JOIN tot USING (query_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank)::INT AS rank FROM rr) WHERE rank <= 5)"""


@query(f"WITH {_POSTED} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_terms(spark, sf_dir):
    posted = scratch(index.postings(corpus(spark, sf_dir)), "postings")
    out = index.term_stats(posted, index.posted_stats(posted).select("n"))
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_POSTED} SELECT n, round(avg_len, 6) AS avg_len FROM stats")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(corpus(spark, sf_dir)).select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {_POSTED}, {_SPARSE} SELECT query_id, chunk_id, sparse_score, sparse_rank FROM sparse")
def sparse_topk(spark, sf_dir):
    posted = scratch(index.postings(corpus(spark, sf_dir)), "postings")
    stats = scratch(index.posted_stats(posted), "stats")
    terms = retrieval.query_terms(questions(spark, sf_dir))
    return retrieval.sparse_topk(terms, posted, index.term_stats(posted, stats.select("n")), stats, 25)


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, dense_score, dense_rank FROM dense")
def dense_topk_text(spark, sf_dir):
    embedded = corpus(spark, sf_dir).select("chunk_id", hash_embed(F.col("text")).alias("vector"))
    asked = questions(spark, sf_dir).select("query_id", hash_embed(F.col("query")).alias("vector"))
    return retrieval.dense_topk(asked, embedded, 25, digits=6)


_HYBRID = f"WITH {_POSTED}, {_SPARSE}, {_DENSE}, {_FUSED}"


@query(_HYBRID + " SELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score, retrieved_by, fused_rank FROM fused")
def rrf_fuse(spark, sf_dir):
    fused = candidates(questions(spark, sf_dir), doc_index(spark, sf_dir))
    return fused.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "retrieved_by", "fused_rank")


@query(
    _HYBRID
    + f""", {_TOP} SELECT query_id, rank AS citation, 'literature' AS source_type, 'PMID' || chunk_id AS record_id, NULL::STRING AS nct_id, chunk_id, 'abstract' AS section,
    'LIN_0000_EMBED' AS lineage_id, retrieved_by, round(rrf_score, 6) AS rrf_score, round(rerank_score, 4) AS rerank_score, source AS source_url, '' AS quality_flags,
    '' AS last_update FROM top JOIN documents ON doc_id = chunk_id"""
)
def hybrid_answer(spark, sf_dir):
    return answer(questions(spark, sf_dir), doc_index(spark, sf_dir), "clinical_researcher").evidence


_ANSWERED = f"""{_HYBRID}, {_TOP},
ctx AS (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context,
    '{policy.EXTRACTIVE}' || chr(10) || chr(10) || string_agg(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 400) || ' [' || rank || ']', chr(10) || chr(10) ORDER BY rank) AS answer,
    list(chunk_id::STRING ORDER BY rank) AS chunks FROM top JOIN documents ON doc_id = chunk_id GROUP BY query_id)"""


@query(_ANSWERED + " SELECT query_id, md5(context) AS context_md5, md5(chr(10) || chr(10) || 'Context passages:' || chr(10) || context || chr(10) || chr(10) || 'Researcher question: ' || text || chr(10) || chr(10) || 'Answer:') AS prompt_md5, answer FROM ctx JOIN benchmark ON item_id = query_id")
def answer_contexts(spark, sf_dir):
    out = answer(questions(spark, sf_dir), doc_index(spark, sf_dir), "clinical_researcher")
    return out.context.join(out.answers, "query_id").select("query_id", F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"), "answer")


_STOP = ", ".join(f"'{w}'" for w in policy.STOP_WORDS)
_CONTENT = f"list_distinct(list_filter({_TOKENS}, lambda t: length(t) > 2 AND t NOT IN ({_STOP})))"


@query(f"""{_ANSWERED}, av AS ({_vectors_sql("ctx", "query_id", "answer")}), an AS (SELECT key, sqrt(sum(val * val)) AS n FROM av GROUP BY key),
qa AS (SELECT q.key, sum(q.val * v.val) AS s FROM qv q JOIN av v USING (key, bucket) GROUP BY q.key),
near AS (SELECT t.query_id, avg(coalesce(s / (qn.n * dn.n), 0)) AS near FROM top t LEFT JOIN dots USING (query_id, chunk_id)
  LEFT JOIN qn ON qn.key = t.query_id LEFT JOIN dn ON dn.key = t.chunk_id GROUP BY t.query_id),
words AS (SELECT t.query_id, list_distinct(flatten(list({_CONTENT.format("text")}))) AS seen FROM top t JOIN documents ON doc_id = chunk_id GROUP BY t.query_id)
SELECT c.query_id, md5(answer) AS answer_md5, round(greatest(near, 0), 4) AS context_relevance,
  CASE WHEN len({_CONTENT.format("answer")}) > 0 THEN round(len(list_intersect({_CONTENT.format("answer")}, seen)) / len({_CONTENT.format("answer")}), 4) ELSE 0 END AS groundedness,
  round(greatest(coalesce(s / (qn.n * an.n), 0), 0), 4) AS answer_relevance
FROM ctx c JOIN near USING (query_id) JOIN words USING (query_id) LEFT JOIN qa ON qa.key = c.query_id LEFT JOIN qn ON qn.key = c.query_id LEFT JOIN an ON an.key = c.query_id""")
def answer_texts(spark, sf_dir):
    out = answer(questions(spark, sf_dir), doc_index(spark, sf_dir), "clinical_researcher")
    return out.answers.join(out.triad, "query_id").select("query_id", F.md5("answer").alias("answer_md5"), "context_relevance", "groundedness", "answer_relevance")


@query(
    _ANSWERED
    + """ SELECT 'ward' AS actor, 'clinical_researcher' AS role, 'RAG_QUERY' AS action, substr(sha256(text), 1, 16) AS query_hash, array_to_string(chunks, ',') AS chunks,
    len(chunks) AS sources, 0::BIGINT AS alerts, 'extractive' AS backend, true AS timed FROM ctx JOIN benchmark ON item_id = query_id"""
)
def answer_audit(spark, sf_dir):
    """The audit entries that answering leaves, as they are read back."""
    audit = Audit(spark, new_path(spark, "audit"))
    answer(questions(spark, sf_dir), doc_index(spark, sf_dir), "clinical_researcher", audit=audit, actor="ward")
    kind = "query_hash string, chunks_returned array<string>, sources_returned array<string>, contradiction_alerts long, llm_backend string, latency_ms double"
    p = F.from_json("payload", kind)
    return audit.load().select(
        *("actor", "role", "action", p["query_hash"].alias("query_hash"), F.array_join(p["chunks_returned"], ",").alias("chunks")),
        *(F.size(p["sources_returned"]).cast("long").alias("sources"), p["contradiction_alerts"].alias("alerts"), p["llm_backend"].alias("backend")),
        (p["latency_ms"] > 0).alias("timed"),
    )


@query(
    _HYBRID
    + """ SELECT * FROM (SELECT f.query_id, chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY abs(length(d.text) - length(b.text)), fused_rank)::INT AS rank
    FROM fused f JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = f.query_id) WHERE rank <= 5"""
)
def rerank_by_scorer(spark, sf_dir):
    """Reranking by a scorer that is given: texts that are about as long as the question come first."""
    by_length = lambda q, t: -F.abs(F.length(t) - F.length(q)).cast("double")
    out = answer(questions(spark, sf_dir), doc_index(spark, sf_dir), "clinical_researcher", scorer=by_length)
    return out.top.select("query_id", "chunk_id", "rank")


@query(f"""
WITH u AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'),
a AS (SELECT u.conv_id, u.turn, q, c.text AS a FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1 AND c.role = 'assistant'),
p AS (SELECT conv_id * 1000 + turn AS query_id, q, a, (SELECT c2.text FROM conversations c2 WHERE c2.conv_id = a.conv_id AND c2.turn = a.turn + 1) AS nxt FROM a),
qv AS ({_vectors_sql("p", "query_id", "q")}), av AS ({_vectors_sql("p", "query_id", "a")}),
qa AS (SELECT q.key, sum(q.val * v.val) AS s FROM qv q JOIN av v USING (key, bucket) GROUP BY q.key),
qn AS (SELECT key, sqrt(sum(val * val)) AS n FROM qv GROUP BY key), an AS (SELECT key, sqrt(sum(val * val)) AS n FROM av GROUP BY key),
r AS (SELECT query_id, q, a, round(greatest(coalesce(s / (qn.n * an.n), 0), 0), 4) AS rel FROM p LEFT JOIN qa ON qa.key = query_id LEFT JOIN qn ON qn.key = query_id LEFT JOIN an ON an.key = query_id)
SELECT query_id, rel AS context_relevance,
  CASE WHEN len({_CONTENT.format("a")}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS groundedness, rel AS answer_relevance FROM r""")
def rag_triad_self(spark, sf_dir):
    """Each assistant turn against the user turn before it, with itself as the context."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    given = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(given, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "query", "answer")
    return rag_triad(pairs, pairs.select("query_id", F.col("answer").alias("text")))


@query(f"""
WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations),
p AS (SELECT u.id AS query_id, u.conv_id, a.id AS answer_id, a.text AS a FROM c u JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
pairs AS (SELECT query_id, c.id AS ctx, c.text FROM p JOIN c ON c.conv_id = p.conv_id AND c.id <> answer_id),
v AS ({_vectors_sql("c", "id", "text")}), n AS (SELECT key, sqrt(sum(val * val)) AS n FROM v GROUP BY key),
dots AS (SELECT x.query_id, x.ctx, sum(a.val * b.val) AS s FROM pairs x JOIN v a ON a.key = x.query_id JOIN v b ON b.key = x.ctx AND b.bucket = a.bucket GROUP BY ALL),
near AS (SELECT x.query_id, avg(coalesce(s / (qn.n * cn.n), 0)) AS near FROM pairs x LEFT JOIN dots USING (query_id, ctx)
  LEFT JOIN n qn ON qn.key = x.query_id LEFT JOIN n cn ON cn.key = x.ctx GROUP BY x.query_id),
words AS (SELECT query_id, list_distinct(flatten(list({_CONTENT.format("text")}))) AS seen FROM pairs GROUP BY query_id),
qa AS (SELECT p.query_id, sum(a.val * b.val) AS s FROM p JOIN v a ON a.key = p.query_id JOIN v b ON b.key = p.answer_id AND b.bucket = a.bucket GROUP BY ALL)
SELECT query_id, round(greatest(near, 0), 4) AS context_relevance,
  CASE WHEN len({_CONTENT.format("a")}) > 0 THEN round(len(list_intersect({_CONTENT.format("a")}, seen)) / len({_CONTENT.format("a")}), 4) ELSE 0 END AS groundedness,
  round(greatest(coalesce(qa.s / (qn.n * an.n), 0), 0), 4) AS answer_relevance
FROM p JOIN near USING (query_id) JOIN words USING (query_id) LEFT JOIN qa USING (query_id) LEFT JOIN n qn ON qn.key = query_id LEFT JOIN n an ON an.key = answer_id""")
def rag_triad_turns(spark, sf_dir):
    """Each assistant turn against the user turn before it, with the other turns of the conversation as contexts."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    given = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(given, ["conv_id", "turn"]).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    others = c.select("conv_id", F.col("turn").alias("other"), "text").join(pairs.select("conv_id", "turn", "query_id"), "conv_id")
    return rag_triad(pairs.select("query_id", "query", "answer"), others.filter("other <> turn + 1").select("query_id", "text"))


_AGE_IN_TEXT = policy.AGE_IN_TEXT


@query(
    f"""WITH t AS ({TRIALS}), s AS (SELECT seq, nct_id, min_age_years AS m,
    list_filter(list_transform(regexp_extract_all(eligibility_criteria, '{_AGE_IN_TEXT}', 1), lambda x: x::DOUBLE), lambda x: abs(x - min_age_years) >= 3) AS off FROM t)
    SELECT 'ELIGIBILITY_AGE_CONFLICT' AS type, seq, nct_id, m AS structured_min_age, off[1] AS stated_in_text, 'Trial ' || coalesce(nct_id, 'None')
    || ' declares a minimum age of ' || m::BIGINT || ' in its structured eligibility field, but its criteria text states ' || off[1]::BIGINT
    || ' years. Verify against the registry before screening.' AS message FROM s WHERE len(off) > 0"""
)
def age_conflicts(spark, sf_dir):
    return retrieval.age_conflicts(trials(spark, sf_dir), text="eligibility_criteria", key="seq")


# --- lakehouse, events, journal ----------------------------------------------------------------------------------------
def _order_table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Orders as a table of two commits, the first three quarters by key and the rest."""
    orders = VersionedTable(spark, new_path(spark, "orders"), clock=lambda: AS_OF)
    incremental_load(table(spark, sf_dir, "orders"), orders, "o_orderkey")
    return orders


_CUT = "(SELECT greatest(1, floor(count(*) * 0.75)) FROM orders)"


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= {_CUT}")
def lakehouse_time_travel(spark, sf_dir):
    return _order_table(spark, sf_dir).read(version=0).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def lakehouse_latest(spark, sf_dir):
    latest = _order_table(spark, sf_dir).read()
    return latest.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    f"""SELECT 0::BIGINT AS version, '{AS_OF}' AS timestamp, 'INITIAL_LOAD' AS operation, {_CUT}::BIGINT AS "numRecords", 'overwrite' AS mode
    UNION ALL SELECT 1, '{AS_OF}', 'INCREMENTAL_DELTA', (count(*) - {_CUT})::BIGINT, 'append' FROM orders"""
)
def lakehouse_history(spark, sf_dir):
    return _order_table(spark, sf_dir).history()


@query("SELECT count(*) AS orders, true AS refused FROM orders")
def lakehouse_drift(spark, sf_dir):
    """A batch with another column is refused and leaves the table as it was."""
    lake = _order_table(spark, sf_dir)
    try:
        lake.write(table(spark, sf_dir, "orders").withColumn("extra", F.lit(1)))
        refused = False
    except SchemaEnforcementError:
        refused = True
    return lake.read().agg(F.count("*").alias("orders")).withColumn("refused", F.lit(refused))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per_topic = [
        ev.to_envelope(e.filter(F.col("event_id") % 3 == i).withColumn("seq", F.expr("event_id div 3")), t, "registry", "seq", F.col("ts"))
        for i, t in enumerate(policy.TOPICS[:3])
    ]
    return per_topic[0].unionByName(per_topic[1]).unionByName(per_topic[2])


_TOPIC = "CASE event_id % 3 WHEN 0 THEN 'raw_clinical_trials' WHEN 1 THEN 'raw_literature' ELSE 'raw_patient_records' END"
_EVENT_ID = "'EVT_' || upper(substr(md5(topic || (event_id // 3)::STRING || 'registry'), 1, 10))"


@query(f"SELECT {_EVENT_ID} AS event_id, topic, 'registry' AS source_system, event_id AS origin, event_type FROM (SELECT *, {_TOPIC} AS topic FROM events)")
def events_envelope(spark, sf_dir):
    payload = F.from_json("payload", "event_id long, event_type string")
    return envelopes(spark, sf_dir).select("event_id", "topic", "source_system", payload["event_id"].alias("origin"), payload["event_type"].alias("event_type"))


@query(f"SELECT topic, count(*) AS published FROM (SELECT {_TOPIC} AS topic FROM events) GROUP BY topic")
def events_topic_counts(spark, sf_dir):
    return ev.topic_counts(envelopes(spark, sf_dir))


@query(
    """SELECT 'EVT_' || upper(substr(md5('raw_literature' || "offset"::STRING || 'registry'), 1, 10)) AS event_id, "offset", event_id AS origin
    FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS "offset" FROM events WHERE event_id % 3 = 1)"""
)
def stream_drain(spark, sf_dir):
    """One topic, published in two parts and drained by a stream after each, and once more: offsets go on in order of arrival."""
    at = new_path(spark, "topics")
    e = table(spark, sf_dir, "events").filter("event_id % 3 = 1")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half, F.lit(False)):
        ev.publish_rows(e.filter(part).orderBy("event_id"), f"{at}/events", "raw_literature", "registry", F.col("ts"))
        ev.drain_topic(spark, f"{at}/events", "raw_literature", f"{at}/drained", f"{at}/checkpoint")
    drained = spark.read.parquet(f"{at}/drained")
    return drained.select("event_id", "offset", F.get_json_object("payload", "$.event_id").cast("long").alias("origin"))


def _trial_topic(spark: SparkSession, sf_dir: str, at: str, rows: DataFrame, topic: str = "raw_clinical_trials") -> DataFrame:
    """Trials published to a topic, and the topic's rows as a stream."""
    ev.publish(ev.to_envelope(rows, topic, "registry", "seq", F.lit(AS_OF).cast("timestamp")), f"{at}/events")
    return ev.from_envelope(ev.read_topic(spark, f"{at}/events", topic), rows.schema)


def _ingest(spark: SparkSession, rows: DataFrame, at: str, checkpoint: str, threshold: float = 1.0) -> VersionedTable:
    lake = VersionedTable(spark, f"{at}/trials")
    ev.ingest_stream(rows, quality.trial_gate(AS_OF), lake, f"{at}/quarantine", "trials", "seq", f"{at}/{checkpoint}", threshold).awaitTermination()
    return lake


@query(_GRADED_T + "SELECT seq, nct_id, data_quality_flags FROM g WHERE quality_failures = ''")
def stream_gate(spark, sf_dir):
    """Trials as events, ingested by a stream through the gate into a table, twice."""
    at = new_path(spark, "ingest")
    rows = _trial_topic(spark, sf_dir, at, trials(spark, sf_dir))
    for _ in range(2):
        lake = _ingest(spark, rows, at, "checkpoint", threshold=0.30)
    return lake.read().select("seq", "nct_id", "data_quality_flags")


@query(_GRADED_T + "SELECT seq, nct_id, data_quality_flags FROM g WHERE quality_failures = ''")
def stream_gate_batches(spark, sf_dir):
    """Trials that come in two batches, of which the second has all of the first again: its rows are duplicates there."""
    at = new_path(spark, "ingest")
    t = trials(spark, sf_dir)
    half = t.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for part in (t.filter(F.col("seq") <= half), t):
        lake = _ingest(spark, _trial_topic(spark, sf_dir, at, part), at, "checkpoint")
    return lake.read().select("seq", "nct_id", "data_quality_flags")


@query(
    f"""WITH t AS ({TRIALS}), v AS (SELECT *, seq % 2 AS stream, {_BLANK.format("brief_title")} AS untitled FROM t),
    p AS (SELECT *, seq > min(seq) OVER (PARTITION BY nct_id, stream) AS again,
      nct_id IS NULL OR untitled OR NOT regexp_matches(coalesce(nct_id, ''), '{policy.NCT_ID}') OR coalesce(min_age_years < 0, false) OR coalesce(min_age_years > 120, false)
      OR coalesce(max_age_years < 0, false) OR coalesce(max_age_years > 120, false) OR coalesce(min_age_years > max_age_years, false) OR coalesce(enrollment < 0, false) AS fatal FROM v),
    a AS (SELECT * FROM p WHERE stream = 0 AND NOT fatal AND NOT again),
    b AS (SELECT * FROM p WHERE stream = 1 AND NOT fatal AND NOT again AND nct_id NOT IN (SELECT nct_id FROM a))
    SELECT seq, nct_id, stream::INT AS stream FROM a UNION ALL SELECT seq, nct_id, stream::INT FROM b"""
)
def stream_gate_two_streams(spark, sf_dir):
    """Two streams into one table, even trials and then odd ones, and the odd ones once more with a new checkpoint: each row that
    has its key first is there once."""
    at = new_path(spark, "ingest")
    t = trials(spark, sf_dir)
    even = _trial_topic(spark, sf_dir, at, t.filter("seq % 2 = 0"))
    odd = _trial_topic(spark, sf_dir, at, t.filter("seq % 2 = 1"), "raw_literature")
    for rows, checkpoint in ((even, "even"), (odd, "odd"), (odd, "anew")):
        lake = _ingest(spark, rows, at, checkpoint)
    return lake.read().select("seq", "nct_id", (F.col("seq") % 2).cast("int").alias("stream"))


@query("""WITH s AS (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i FROM documents GROUP BY lang, source),
l AS (SELECT lang, i, 'LIN_' || lpad(i::STRING, 4, '0') || '_' || upper(source) AS id, source, n FROM s)
SELECT lang AS run_id, string_agg('  ' || id || chr(10) || '     operation : ' || upper(source) || chr(10) || '     inputs    : ' || coalesce(prev, '-') || chr(10) || '     outputs   : '
  || source || '@v0' || chr(10) || '     records   : ' || n || chr(10) || '     at        : 2026-01-01', chr(10) || '  |' || chr(10) || '  v' || chr(10) ORDER BY id) AS chain
FROM (SELECT *, lag(id) OVER (PARTITION BY lang ORDER BY i) AS prev FROM l) GROUP BY lang""")
def lineage_chain(spark, sf_dir):
    """Each language's sources as a chain of operations, rendered."""
    return chain_text(source_nodes(spark, sf_dir))


def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy("source")
    counted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("record_count"))
    named = counted.withColumn(
        "lineage_id", F.concat(F.lit("LIN_"), F.lpad((F.row_number().over(order) - 1).cast("string"), 4, "0"), F.lit("_"), F.upper("source"))
    )
    return named.select(
        F.col("lang").alias("run_id"),
        "lineage_id",
        F.array_compact(F.array(F.lag("lineage_id").over(order))).alias("inputs"),
        F.array(F.concat("source", F.lit("@v0"))).alias("outputs"),
        "record_count",
        F.upper("source").alias("operation"),
        F.lit(AS_OF).alias("timestamp"),
    )


_NODES = """WITH s AS (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i FROM documents GROUP BY lang, source),
l AS (SELECT lang, i, 'LIN_' || lpad(i::STRING, 4, '0') || '_' || upper(source) AS id, source, n FROM s)"""


@query(_NODES + " SELECT id AS lineage_id, n AS record_count FROM l WHERE lang = (SELECT min(lang) FROM l)")
def lineage_ancestry(spark, sf_dir):
    """All that the last node of the first language's run comes from."""
    nodes = source_nodes(spark, sf_dir)
    last = nodes.orderBy("run_id", F.desc("lineage_id")).select("run_id", "lineage_id").first()
    return ancestry(nodes, last["lineage_id"], last["run_id"]).select("lineage_id", "record_count")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT a.o_custkey::STRING AS run_id, a.o_orderkey::STRING AS lineage_id, b.o_orderkey::STRING AS ancestor FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.i <= a.i""")
def lineage_closure(spark, sf_dir):
    """All ancestors of all nodes at once: each customer's orders as a run, in which each order follows the one before."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("lineage_id"), "o_orderkey")
    before = F.lag("lineage_id").over(Window.partitionBy("run_id").orderBy("o_orderkey"))
    return closure(orders.select("run_id", "lineage_id", F.array_compact(F.array(before)).alias("inputs")))


@query(_NODES + " SELECT doc_id AS citation, id AS lineage_id, l.source || '@v0' AS outputs FROM documents d JOIN l ON d.source = l.source AND d.lang = l.lang WHERE l.lang = (SELECT min(lang) FROM l)")
def lineage_trace(spark, sf_dir):
    """Documents of the first language as evidence, each with what its node wrote."""
    nodes = source_nodes(spark, sf_dir)
    run = nodes.agg(F.min("run_id")).first()[0]
    mine = nodes.filter(F.col("run_id") == run)
    of_source = mine.select(F.lower(F.substring("lineage_id", 10, 100)).alias("source"), "lineage_id")
    cited = table(spark, sf_dir, "documents").filter(F.col("lang") == run).join(of_source, "source").select(F.col("doc_id").alias("citation"), "lineage_id")
    return trace(cited, mine).select("citation", "lineage_id", F.array_join("outputs", ",").alias("outputs"))


@query(
    f"""WITH t AS {_CLEAN_T}, l AS {_CLEAN_L}, ta AS ({TRIALS}), la AS ({ARTICLES}), c AS ({_trial_chunks_sql("t")} UNION ALL {_article_chunks_sql("l")}),
    n AS (SELECT (SELECT count(*) FROM ta WHERE coalesce(nct_id, '') <> '') + (SELECT count(*) FROM la WHERE coalesce(pmid, '') <> '') + (SELECT count(*) FROM customer) AS came,
      (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM l) AS l, (SELECT count(*) FROM customer) AS p, (SELECT count(*) FROM c) AS cut, (SELECT count(*) FROM c WHERE NOT ({_GATED})) AS admitted)
    SELECT 'LIN_0000_INGEST' AS lineage_id, 'registry,literature,records' AS inputs, came AS record_count, 0 AS depth FROM n
    UNION ALL SELECT 'LIN_0001_QUALITY_GATE', 'LIN_0000_INGEST', t, 1 FROM n UNION ALL SELECT 'LIN_0002_LAKEHOUSE_COMMIT', 'LIN_0001_QUALITY_GATE', t, 2 FROM n
    UNION ALL SELECT 'LIN_0003_QUALITY_GATE', 'LIN_0000_INGEST', l, 1 FROM n UNION ALL SELECT 'LIN_0004_LAKEHOUSE_COMMIT', 'LIN_0003_QUALITY_GATE', l, 2 FROM n
    UNION ALL SELECT 'LIN_0005_FHIR_VALIDATION', 'LIN_0002_LAKEHOUSE_COMMIT', t + p, 3 FROM n UNION ALL SELECT 'LIN_0006_PHI_DEIDENTIFICATION', 'LIN_0005_FHIR_VALIDATION', p, 4 FROM n
    UNION ALL SELECT 'LIN_0007_CHUNK_EMBED', 'LIN_0002_LAKEHOUSE_COMMIT,LIN_0004_LAKEHOUSE_COMMIT', cut, 5 FROM n UNION ALL SELECT 'LIN_0008_VECTOR_INDEX', 'LIN_0007_CHUNK_EMBED', admitted, 6 FROM n"""
)
def lineage_of_jobs(spark, sf_dir):
    """The nodes that the jobs leave from ingest to index, as they are read back, each with how many it comes from."""
    lineage = _run_jobs(spark, sf_dir)[0]
    nodes = lineage.load()
    depth = closure(nodes).groupBy("lineage_id").agg((F.count("*") - 1).cast("int").alias("depth"))
    return nodes.join(depth, "lineage_id").select("lineage_id", F.array_join("inputs", ",").alias("inputs"), "record_count", "depth")


def _run_jobs(spark: SparkSession, sf_dir: str) -> tuple[Lineage, Index]:
    """All jobs over both sources and the patients: ingest, gates and commits, governance, index."""
    at = new_path(spark, "jobs")
    lineage, audit = Lineage(spark, f"{at}/lineage", "r"), Audit(spark, f"{at}/audit")
    t, a, p = trials(spark, sf_dir), articles(spark, sf_dir), patients(spark, sf_dir)
    feeds = [Feed("raw_clinical_trials", "registry", t, "nct_id"), Feed("raw_literature", "literature", a, "pmid"), Feed("raw_patient_records", "records", p)]
    came = ingest(feeds, f"{at}/landing", f"{at}/events", lineage, F.lit(AS_OF).cast("timestamp"))
    taken = {topic: ev.from_envelope(spark.read.parquet(f"{at}/events").filter(F.col("topic") == topic), rows.schema) for topic, rows in (("raw_clinical_trials", t), ("raw_literature", a))}
    gates = {"raw_clinical_trials": quality.trial_gate(AS_OF), "raw_literature": quality.literature_gate(2026)}
    lakes = {topic: VersionedTable(spark, f"{at}/{topic}") for topic in taken}
    nodes = [load_governed(taken[x], gates[x], lakes[x], f"{at}/quarantine", x, AS_OF, lineage, [], halt=False, after=came).node for x in taken]
    govern(lakes["raw_clinical_trials"].read(), p, SALT, lineage, audit, nodes[0])
    build_index(*(lake.read() for lake in lakes.values()), f"{at}/index", tuple(nodes), lineage=lineage, audit=audit)
    return lineage, Index.open(spark, f"{at}/index")


@query("SELECT item_id AS query_id, 5 AS evidence, 5 AS traced, true AS answered FROM benchmark")
def evidence_versions(spark, sf_dir):
    """From ingest to answers: how many rows of evidence each question has, and how many lead to the version of their own table."""
    lineage, built = _run_jobs(spark, sf_dir)
    out = answer(questions(spark, sf_dir), built, "clinical_researcher", audit=Audit(spark, new_path(spark, "audit")))
    traced = table_versions(out.evidence, lineage.load())
    own = F.when(F.col("source_type") == "trial", "/raw_clinical_trials@v1").otherwise("/raw_literature@v1")
    right = (F.size("table_versions") == 1) & F.endswith(F.col("table_versions")[0], own)
    counted = traced.groupBy("query_id").agg(F.count("*").cast("int").alias("evidence"), F.count_if(right).cast("int").alias("traced"))
    told = out.results.select("query_id", (F.col("audit_id").startswith("AUD_") & (F.col("candidates_stage_one") >= 5) & F.col("answer").isNotNull()).alias("answered"))
    return counted.join(told, "query_id")


@query("SELECT event_id AS seq, event_type AS action, user_id::STRING AS actor FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark, sf_dir):
    """The last 50 audit entries, with events as entries."""
    entries = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor")
    )
    return tail(entries, 50).select("seq", "action", "actor")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, 'data_engineer' AS role, 'EVENT' AS action, event_type AS kind, event_id FROM events ORDER BY event_id DESC LIMIT 50")
def audit_log(spark, sf_dir):
    """Events appended to an audit as entries in two appends, and the last 50 of what is read back, numbered on."""
    audit = Audit(spark, new_path(spark, "audit"), clock=lambda: AS_OF)
    e = table(spark, sf_dir, "events")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        rows = e.filter(part).orderBy("event_id").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("payload"))
        audit.log_rows(rows, "pipeline", "data_engineer", "EVENT")
    value = lambda name: F.get_json_object("payload", f"$.{name}")
    return audit.tail(50).select("seq", "role", "action", value("event_type").alias("kind"), value("event_id").cast("long").alias("event_id"))


# --- refusals and plug-ins ---------------------------------------------------------------------------------------------
@query(
    _GRADED_T
    + """, b AS (SELECT lang, quality_failures FROM g JOIN documents ON doc_id = seq WHERE NOT (seq % 3 = 0 AND quality_failures = ''))
    SELECT lang AS batch, count(*) AS evaluated, count(*) FILTER (quality_failures <> '') AS rejected, count(*) FILTER (quality_failures <> '') / count(*) > 0.1 AS halted FROM b GROUP BY lang"""
)
def halted_batches(spark, sf_dir):
    """Trials in a batch for each language, without a third of the clean ones: which batches the gate halts at a tenth."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang")
    graded = scratch(graded_trials(spark, sf_dir).join(docs, "seq").filter("NOT (seq % 3 = 0 AND quality_failures = '')"), "graded")
    out = []
    for r in graded.select("lang").distinct().orderBy("lang").collect():  # a handful of languages
        verdict = scratch(quality.verdict(graded.filter(F.col("lang").eqNullSafe(r["lang"])), threshold=0.1), "verdict")
        try:
            quality.enforce(verdict)
            halted = False
        except quality.BatchHalted:
            halted = True
        out.append(verdict.select(F.lit(r["lang"]).alias("batch"), "evaluated", "rejected", F.lit(halted).alias("halted")))
    return reduce(DataFrame.unionByName, out)


@query(
    f"""SELECT role, count(*) AS customers, role IN ({", ".join(f"'{r}'" for r in policy.ROLE_CLASSES)}) AS known
    FROM (SELECT CASE c_custkey % 6 {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(policy.ROLE_CLASSES))} ELSE lower(c_mktsegment) END AS role FROM customer) GROUP BY role"""
)
def checked_roles(spark, sf_dir):
    """Roles that customers come with, and whether an answer would be refused to them."""
    c = table(spark, sf_dir, "customer")
    role = F.lower("c_mktsegment")
    for i, r in enumerate(policy.ROLE_CLASSES):
        role = F.when(F.col("c_custkey") % 6 == i, r).otherwise(role)
    counted = c.groupBy(role.alias("role")).agg(F.count("*").alias("customers"))

    def known(name: str) -> bool:
        try:
            return bool(governance.check_role(name))
        except governance.UnknownRole:
            return False

    roles = [r["role"] for r in counted.select("role").collect()]  # as many as there are roles and segments
    return counted.withColumn("known", F.col("role").isin([r for r in roles if known(r)]))


@query("SELECT doc_id, (length(coalesce(text, '')) % 1000)::DOUBLE AS a, len(string_split(coalesce(text, ''), ' '))::DOUBLE AS b, 3::INT AS width FROM documents")
def encoder_vectors(spark, sf_dir):
    """Vectors of an encoder that is given: a plain function from texts to a matrix, loaded once in each worker."""

    def load():
        return lambda texts: np.array([[len(t) % 1000, t.count(" ") + 1, 1.0] for t in texts], dtype=np.float32).reshape(len(texts), 3)

    encoded = index.embed(table(spark, sf_dir, "documents"), encoder=lambda c: encode_with(load, c))
    return encoded.select("doc_id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"), F.size("vector").alias("width"))
