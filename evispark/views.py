"""Views that give the driver tables the shapes of trials, articles, patients and notes, with seeded defects.

The SQL is portable: Spark and DuckDB give equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scratch import dealt

#: The day that all checks count from.
AS_OF = "2026-01-01"

TRIALS = """
SELECT doc_id AS seq,
  CASE WHEN doc_id % 97 = 5 THEN NULL
       WHEN doc_id % 89 = 7 THEN 'BAD' || CAST(doc_id AS STRING)
       WHEN doc_id % 83 = 11 THEN 'NCT' || lpad(CAST(doc_id - 1 AS STRING), 8, '0')
       ELSE 'NCT' || lpad(CAST(doc_id AS STRING), 8, '0') END AS nct_id,
  CASE WHEN doc_id % 71 = 3 THEN '  ' ELSE substr(text, 1, 60) END AS brief_title,
  CASE doc_id % 11 WHEN 0 THEN 'RECRUITING' WHEN 1 THEN 'NOT_YET_RECRUITING'
       WHEN 2 THEN 'ACTIVE_NOT_RECRUITING' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'suspended'
       WHEN 5 THEN 'TERMINATED' WHEN 6 THEN 'WITHDRAWN' WHEN 7 THEN 'UNKNOWN'
       WHEN 8 THEN 'AVAILABLE' WHEN 9 THEN 'MYSTERY' ELSE NULL END AS overall_status,
  CASE WHEN doc_id % 59 = 1 THEN 'not a date' WHEN doc_id % 59 = 2 THEN '2019-03'
       ELSE CAST(DATE '2026-01-01' - CAST((doc_id * 7) % 4000 AS INT) AS STRING) END AS last_update,
  CASE WHEN doc_id % 41 = 2 THEN NULL ELSE text END AS brief_summary,
  CASE doc_id % 3 WHEN 0 THEN 'Asthma; Hypertension' WHEN 1 THEN 'Migraine' ELSE '' END AS conditions,
  'INTERVENTIONAL' AS study_type,
  CASE doc_id % 4 WHEN 0 THEN 'PHASE2' WHEN 1 THEN 'PHASE2; PHASE3' WHEN 2 THEN 'NA' ELSE '' END AS phase,
  CASE WHEN doc_id % 53 = 4 THEN -1.0 WHEN doc_id % 53 = 5 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS enrollment,
  'Inclusion Criteria:' || chr(10) || '* Participants must be at least '
    || CAST(doc_id % 70 + doc_id % 6 AS STRING) || ' years of age' || chr(10) || chr(10) || text AS eligibility_criteria,
  CASE WHEN doc_id % 29 = 9 THEN NULL ELSE CAST(doc_id % 70 AS DOUBLE) END AS min_age_years,
  CASE WHEN doc_id % 61 = 6 THEN 5.0 WHEN doc_id % 7 = 0 THEN NULL
       ELSE CAST(doc_id % 70 + 25 AS DOUBLE) END AS max_age_years,
  CASE doc_id % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'FEMALE' ELSE NULL END AS sex,
  doc_id % 2 = 0 AS healthy_volunteers,
  'DRUG: agent ' || source AS interventions,
  'Town ' || source || ', ' || lang AS locations,
  'Sponsor ' || source AS sponsor,
  'https://registry.example/study/' || CAST(doc_id AS STRING) AS source_url
FROM documents
"""

ARTICLES = """
SELECT doc_id AS seq,
  CASE WHEN doc_id % 97 = 5 THEN NULL WHEN doc_id % 89 = 7 THEN 'X' || CAST(doc_id AS STRING)
       WHEN doc_id % 83 = 11 THEN CAST(doc_id - 1 AS STRING) ELSE CAST(doc_id AS STRING) END AS pmid,
  CASE WHEN doc_id % 71 = 3 THEN '' ELSE substr(text, 1, 60) END AS title,
  CASE WHEN doc_id % 41 = 2 THEN NULL ELSE 'BACKGROUND: ' || substr(text, 1, 400) || chr(10)
       || 'RESULTS: ' || substr(text, 401) END AS abstract,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'Journal of ' || source END AS journal,
  CASE WHEN doc_id % 67 = 1 THEN 1700 WHEN doc_id % 67 = 2 THEN 2040 WHEN doc_id % 67 = 3 THEN NULL
       ELSE CAST(1995 + doc_id % 31 AS INT) END AS pub_year,
  'Doe ' || upper(lang) AS authors,
  CASE doc_id % 4 WHEN 0 THEN 'Journal Article; Review' WHEN 1 THEN 'Meta-Analysis'
       WHEN 2 THEN 'Letter' ELSE '' END AS publication_types,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '10.9999/x.' || CAST(doc_id AS STRING) END AS doi,
  'https://literature.example/' || CAST(doc_id AS STRING) AS source_url
FROM documents
"""

PATIENTS = """
SELECT c_custkey AS seq,
  CASE WHEN c_custkey % 31 = 1 THEN '' ELSE 'Given' || CAST(c_custkey AS STRING) || ' Family' || CAST(c_nationkey AS STRING) END AS patient_name,
  CASE WHEN c_custkey % 37 = 2 THEN NULL ELSE 'MRN-' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS medical_record_number,
  CASE WHEN c_custkey % 23 = 3 THEN '07/22/1961'
       ELSE CAST(DATE '2000-01-01' - CAST((c_custkey * 13) % 20000 AS INT) AS STRING) END AS date_of_birth,
  '+44-20-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS phone,
  CASE WHEN c_custkey % 19 = 4 THEN 'not-an-email' ELSE 'p' || CAST(c_custkey AS STRING) || '@clinic.example' END AS email,
  CAST(c_custkey % 900 + 1 AS STRING) || ' Market Road' AS address,
  CASE c_custkey % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'F' WHEN 3 THEN 'unknown' ELSE NULL END AS gender,
  CAST(c_custkey % 90 AS INT) AS age_years,
  'Condition ' || c_mktsegment || CASE WHEN c_custkey % 17 = 5 THEN ', call ' || '212-555-0' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') ELSE '' END AS diagnosis,
  c_acctbal / 1000 AS hba1c,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'hypertension' END AS comorbidities
FROM customer
"""

NOTES = """
SELECT doc_id AS note_id,
  text
  || CASE WHEN doc_id % 6 = 0 THEN ' MRN-' || lpad(CAST(doc_id AS STRING), 7, '0') ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ' ssn 123-45-' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') ELSE '' END
  || CASE WHEN doc_id % 8 = 0 THEN ' id 1' || lpad(CAST(doc_id AS STRING), 9, '0') ELSE '' END
  || CASE WHEN doc_id % 9 = 0 THEN ' mail a.b' || CAST(doc_id AS STRING) || '@clinic.example ' ELSE '' END
  || CASE WHEN doc_id % 10 = 0 THEN ' tel +44-20-555-' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN ' born 1961-07-22 ' ELSE '' END
  || CASE WHEN doc_id % 12 = 0 THEN ' at ' || CAST(doc_id % 900 + 1 AS STRING) || ' North Market Road ' ELSE '' END
  || CASE WHEN doc_id % 13 = 0 THEN ' in NCT05550123 ' ELSE '' END AS text
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, sql: str, name: str = "documents") -> DataFrame:
    """The view over the table ``name`` of a data folder, without registering anything."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {given}"), given=table(spark, sf_dir, name))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRIALS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ARTICLES)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PATIENTS, "customer")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NOTES)
