"""Declared schemas of everything that is read; nothing is inferred."""

from pyspark.sql import types as T


def parsed(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


STUDY = (
    "protocolSection struct<"
    "identificationModule: struct<nctId: string, briefTitle: string>,"
    "statusModule: struct<overallStatus: string, lastUpdatePostDateStruct: struct<date: string>>,"
    "descriptionModule: struct<briefSummary: string>,"
    "conditionsModule: struct<conditions: array<string>>,"
    "designModule: struct<studyType: string, phases: array<string>, enrollmentInfo: struct<count: bigint>>,"
    "eligibilityModule: struct<eligibilityCriteria: string, minimumAge: string, maximumAge: string, sex: string, healthyVolunteers: boolean>,"
    "armsInterventionsModule: struct<interventions: array<struct<type: string, name: string>>>,"
    "contactsLocationsModule: struct<locations: array<struct<city: string, state: string, country: string>>>,"
    "sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>>"
)
TRIAL = (
    "nct_id string, brief_title string, overall_status string, last_update string, brief_summary string, conditions string, "
    "study_type string, phase string, enrollment double, eligibility_criteria string, min_age_years double, max_age_years double, "
    "sex string, healthy_volunteers boolean, interventions string, locations string, sponsor string, source_url string"
)
ARTICLE = (
    "pmid string, title string, abstract string, journal string, pub_year int, authors string, publication_types string, "
    "doi string, source_url string"
)
PATIENT = (
    "patient_name string, medical_record_number string, date_of_birth string, phone string, email string, address string, "
    "gender string, age_years int, diagnosis string, hba1c double, comorbidities string"
)
#: An article as its XML has it, before it is flattened.
ARTICLE_PARTS = (
    "pmid string, title string, sections array<struct<label: string, body: string>>, journal string, year string, medline_date string, "
    "authors array<struct<last_name: string, initials: string>>, publication_types array<string>, "
    "ids array<struct<kind: string, value: string>>"
)
ENVELOPE = "event_id string, event_time timestamp, topic string, offset long, source_system string, payload string"
COMMIT = "version long, timestamp string, operation string, batch string, mode string, numRecords long, schema string"
LINEAGE = (
    "lineage_id string, timestamp string, operation string, inputs array<string>, outputs array<string>, record_count long, "
    "details string, run_id string"
)
AUDIT = "audit_id string, timestamp string, seq long, actor string, role string, action string, payload string"
