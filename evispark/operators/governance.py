"""De-identification, field classes, masking by role, and the gate before an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import policy
from ..functions.phi import found_families, is_gated, redact_phi, scan_phi
from ..functions.text import exploded, pseudonymise


class UnknownRole(ValueError):
    """A role that has no policy."""


def class_of(field: str) -> str:
    return policy.FIELD_CLASS.get(field, policy.UNLISTED_CLASS)


def classify(df: DataFrame) -> DataFrame:
    """(field, class) of every column."""
    return df.sparkSession.createDataFrame([(c, class_of(c)) for c in df.columns], "field string, class string")


def phi_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, value): one row for each hit in a text column."""
    held = df.select(key, F.col(text).alias("_text"))
    return exploded(held, scan_phi(F.col("_text")), "hit").select(key, "hit.type", "hit.value")


def deidentify(df: DataFrame, salt: str, digits: int = 10) -> tuple[DataFrame, DataFrame]:
    """(safe rows, findings) of patient rows.

    RESTRICTED columns go, each a finding ``FIELD:<name>`` where it has a value; identifiers in other text columns
    are redacted and found. patient_pseudonym comes from the record number or, if that is null or empty, the name;
    with neither it is null, so such patients don't share one. A column of that name is replaced.
    """
    restricted = [c for c in df.columns if class_of(c) == "RESTRICTED"]
    kept = [f for f in df.schema.fields if f.name not in restricted and f.name != "patient_pseudonym"]
    identity = F.coalesce(F.nullif("medical_record_number", F.lit("")), F.nullif("patient_name", F.lit("")))
    texts = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    safe = df.select(
        *[redact_phi(F.col(f.name)).alias(f.name) if f.name in texts else F.col(f.name) for f in kept],
        pseudonymise(identity, salt, digits).alias("patient_pseudonym"),
    )
    whole = [F.struct(F.lit(f"FIELD:{c}").alias("type"), F.col(c).cast("string").alias("value")) for c in restricted]
    hits = F.flatten(F.array(F.array(*whole), *[scan_phi(F.col(c)) for c in texts])) if whole else F.flatten(F.array(*[scan_phi(F.col(c)) for c in texts]))
    findings = exploded(df, hits, "_hit").select("_hit.type", "_hit.value").filter("value IS NOT NULL")
    return safe, findings


def phi_summary(findings: DataFrame) -> DataFrame:
    """(type, hits) for each family of findings."""
    return findings.groupBy("type").agg(F.count("*").alias("hits"))


def check_role(role: str) -> str:
    if role not in policy.ROLE_CLASSES:
        raise UnknownRole(f"no policy for role {role!r}")
    return role


def apply_access_policy(df: DataFrame, role: str) -> DataFrame:
    """Columns that the role may not read become ``***MASKED[<class>]***``; an unknown role reads nothing."""
    allowed = policy.ROLE_CLASSES.get(role, ())
    return df.select(*[F.col(c) if class_of(c) in allowed else F.lit(f"***MASKED[{class_of(c)}]***").alias(c) for c in df.columns])


def masked_for_roles(df: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """Every row once for each role, as (role, key, and the other columns as text). The roles are a literal array, so
    this is one pass without a join."""
    held = df.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    columns = []
    for c in df.columns:
        if c == key:
            continue
        readers = [r for r in roles if class_of(c) in policy.ROLE_CLASSES.get(r, ())]
        shown = F.col("role").isin(*readers) if readers else F.lit(False)
        columns.append(F.when(shown, F.col(c).cast("string")).otherwise(F.lit(f"***MASKED[{class_of(c)}]***")).alias(c))
    return held.select("role", key, *columns)


def phi_gate(chunks: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(admitted, blocked) chunks: those with a record number, SSN, national id, e-mail or street address are blocked."""
    marked = is_gated(F.col(text))
    return chunks.filter(~marked), chunks.filter(marked)


def blocked_report(blocked: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, phi_types): the gated families in each blocked chunk, sorted."""
    return blocked.select(key, found_families(F.col(text), policy.GATED_FAMILIES).alias("phi_types"))


def redact_queries(queries: DataFrame, protect_ids: bool = False) -> DataFrame:
    """(query_id, query) with query_redacted, phi_stripped (sorted families) and query_hash (16 hex of SHA-256)."""
    q = F.col("query")
    return queries.withColumns(
        {
            "query_redacted": redact_phi(q, protect_ids),
            "phi_stripped": found_families(F.coalesce(q, F.lit(""))),
            "query_hash": F.substring(F.sha2(q, 256), 1, 16),
        }
    )
