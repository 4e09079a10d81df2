"""Vocabularies, classes, patterns and word lists that results depend on."""

# Data class of each field; a field that is not listed is CONFIDENTIAL.
PUBLIC_FIELDS = (
    "nct_id",
    "brief_title",
    "brief_summary",
    "conditions",
    "eligibility_criteria",
    "interventions",
    "overall_status",
    "phase",
    "sponsor",
    "locations",
    "min_age_years",
    "max_age_years",
    "sex",
    "enrollment",
    "last_update",
    "pmid",
    "title",
    "abstract",
    "journal",
    "pub_year",
    "authors",
    "publication_types",
    "doi",
    "source_url",
)
RESTRICTED_FIELDS = (
    "patient_name",
    "medical_record_number",
    "date_of_birth",
    "phone",
    "email",
    "address",
)
INTERNAL_FIELDS = (
    "patient_pseudonym",
    "gender",
    "age_years",
    "diagnosis",
    "hba1c",
    "comorbidities",
)
FIELD_CLASS = {
    name: label
    for label, names in (("PUBLIC", PUBLIC_FIELDS), ("RESTRICTED", RESTRICTED_FIELDS), ("INTERNAL", INTERNAL_FIELDS))
    for name in names
}
UNLISTED_CLASS = "CONFIDENTIAL"

# The classes that each role may read.
ROLE_CLASSES = {
    "clinical_researcher": ("PUBLIC", "INTERNAL"),
    "treating_physician": ("PUBLIC", "INTERNAL", "RESTRICTED"),
    "data_engineer": ("PUBLIC",),
    "public": ("PUBLIC",),
}

# Identifier families and their patterns, in the order in which they are redacted.
PHI_PATTERNS = {
    "MRN": r"(?i)\bMRN[-\s]?[A-Z0-9]{4,12}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "NATIONAL_ID": r"\b[12]\d{9}\b",
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
    "PHONE": r"(?:\+\d{1,3}[-\s]?)?(?:\d{2,4}[-\s]?){2,4}\d{2,4}\b",
    "DATE_OF_BIRTH": r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b",
    "STREET_ADDRESS": r"\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Road|Rd|Avenue|Ave|District|Boulevard|Blvd)\b",
}
# Families that keep a chunk out of the index.
GATED_FAMILIES = ("MRN", "SSN", "NATIONAL_ID", "EMAIL", "STREET_ADDRESS")

# Registry statuses, and the study status that nine of them stand for.
TRIAL_STATUSES = (
    "RECRUITING",
    "NOT_YET_RECRUITING",
    "ACTIVE_NOT_RECRUITING",
    "COMPLETED",
    "ENROLLING_BY_INVITATION",
    "SUSPENDED",
    "TERMINATED",
    "WITHDRAWN",
    "UNKNOWN",
    "AVAILABLE",
    "NO_LONGER_AVAILABLE",
    "APPROVED_FOR_MARKETING",
    "TEMPORARILY_NOT_AVAILABLE",
    "WITHHELD",
)
STUDY_STATUS_OF = {
    "RECRUITING": "active",
    "NOT_YET_RECRUITING": "approved",
    "ENROLLING_BY_INVITATION": "active",
    "ACTIVE_NOT_RECRUITING": "closed-to-accrual",
    "COMPLETED": "completed",
    "SUSPENDED": "temporarily-closed-to-accrual",
    "TERMINATED": "administratively-completed",
    "WITHDRAWN": "withdrawn",
    "UNKNOWN": "in-review",
}
STUDY_STATUSES = (
    "active",
    "administratively-completed",
    "approved",
    "closed-to-accrual",
    "closed-to-accrual-and-intervention",
    "completed",
    "disapproved",
    "in-review",
    "temporarily-closed-to-accrual",
    "temporarily-closed-to-accrual-and-intervention",
    "withdrawn",
)
GENDERS = ("male", "female", "other", "unknown")

# Forms of identifiers, dates and addresses.
NCT_ID = r"^(NCT\d{8}|SYNTH\d{8})$"
PMID = r"^\d{1,8}$"
FHIR_DATE = r"^\d{4}(-\d{2}(-\d{2})?)?$"
EMAIL_ADDRESS = r"^[\w.+-]+@[\w-]+\.[\w.]{2,}$"
AGE = r"(?i)^(\d+(?:\.\d+)?)\s*(year|month|week|day)"
AGE_IN_TEXT = r"(?i)(?:at least|aged|age of|older than|minimum age of|>=?\s*)\s*(\d{1,3})\s*(?:years|yrs|year)"

# Publication types that count as evidence.
EVIDENCE_TYPES = (
    "journal article",
    "randomized controlled trial",
    "meta-analysis",
    "systematic review",
    "review",
    "clinical trial",
    "comparative study",
    "multicenter study",
    "observational study",
)

# Words that do not count as content.
STOP_WORDS = (
    "the",
    "a",
    "an",
    "of",
    "for",
    "in",
    "on",
    "to",
    "and",
    "or",
    "is",
    "are",
    "with",
    "that",
    "this",
    "it",
    "as",
    "be",
    "by",
    "at",
    "from",
    "was",
    "were",
)

# Topics of events.
TOPICS = ("raw_clinical_trials", "raw_literature", "raw_patient_records", "validated_records")

# What conformance checks say; %s stands for the value.
PATIENT_ISSUES = {
    "identifier": "Patient.identifier is required (1..*) and must carry a value",
    "family": "Patient.name.family is required for an official name",
    "gender": "Patient.gender '%s' is outside the bound value set administrative-gender (female|male|other|unknown)",
    "birth_date": "Patient.birthDate '%s' is not a valid FHIR date",
    "email": "Patient.telecom(email) '%s' is not a valid address",
}
STUDY_ISSUES = {
    "identifier": "ResearchStudy.identifier is required and must carry a value",
    "title": "ResearchStudy.title is required for a citable study",
    "no_status": "ResearchStudy.status could not be derived from registry status '%s' - no mapping into the FHIR value set",
    "status": "ResearchStudy.status '%s' is outside the R4 value set",
    "negative": "ResearchStudy.enrollment must not be negative",
    "number": "ResearchStudy.enrollment '%s' is not a number",
}

# The frame of a prompt (system, context, question), the first line of an extractive answer, the age alert.
PROMPT = "%s\n\nContext passages:\n%s\n\nResearcher question: %s\n\nAnswer:"
EXTRACTIVE = "[EXTRACTIVE MODE - no generative model configured; evidence quoted verbatim]"
AGE_ALERT = (
    "Trial %s declares a minimum age of %s in its structured eligibility field, but its criteria text states %s years. "
    "Verify against the registry before screening."
)
