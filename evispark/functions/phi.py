"""Finding and redacting identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import GATED_FAMILIES, PHI_PATTERNS

#: Every family needs a digit (of any script, as the patterns do), an @ or the letters of MRN; other texts skip all patterns.
_HINT = r"(?U)[\d@]|(?i:mrn)"
#: What a hit of each gated family has in it, and how each of these begins: most texts have none, and are searched once.
_NEEDS = {
    "MRN": r"[Mm][Rr][Nn]",
    "SSN": r"\d{3}-\d{2}-\d{4}",
    "NATIONAL_ID": r"[12]\d{9}",
    "EMAIL": r"@",
    "STREET_ADDRESS": r"\d\s+[A-Z][a-z]+\s",
}
_LIKELY = rf"(?U)(?=[\d@Mm])(?:{'|'.join(_NEEDS[family] for family in GATED_FAMILIES)})"
_TRIAL_ID = r"NCT\d{8}"
_BEFORE_ID = rf"(?={_TRIAL_ID})"


def unicode_words(pattern: str) -> str:
    return f"(?U){pattern}"


def scan_phi(text: Column) -> Column:
    """All hits of all families as array<struct<type, value>>; families may overlap. Null text: no hit."""

    def of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(unicode_words(pattern)), F.lit(0))
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    hits = [of(kind, p) for kind, p in PHI_PATTERNS.items()]
    none = F.array().cast("array<struct<type: string, value: string>>")
    return F.when(text.rlike(_HINT), F.concat(*hits)).otherwise(none)


def redact_phi(text: Column, protect_ids: bool = False) -> Column:
    """Each hit, family by family in order, becomes ``[REDACTED_<TYPE>]``; null stays null.

    The phone pattern takes the digits of a registry id such as NCT01234567. With ``protect_ids`` those are kept.
    """
    out = text
    if protect_ids:  # an id's digits stand as private-use characters while the patterns run
        private = "".join(chr(0xE000 + d) for d in range(10))
        parts = F.split(text, _BEFORE_ID)
        hidden = F.transform(
            parts,
            lambda part, i: F.when(
                i > 0, F.concat(F.translate(F.substring(part, 1, 11), "0123456789", private), F.substring(part, F.lit(12), F.length(part)))
            ).otherwise(part),
        )
        # a text that begins with an id has no part before it
        first = F.when(text.rlike(rf"^{_TRIAL_ID}"), F.translate(F.substring(hidden[0], 1, 11), "0123456789", private)).otherwise(F.lit(""))
        rest = F.when(text.rlike(rf"^{_TRIAL_ID}"), F.substring(hidden[0], F.lit(12), F.length(hidden[0]))).otherwise(hidden[0])
        out = F.concat(first, rest, F.array_join(F.slice(hidden, 2, F.greatest(F.size(hidden) - 1, F.lit(0))), ""))
    for kind, p in PHI_PATTERNS.items():
        out = F.regexp_replace(out, unicode_words(p), f"[REDACTED_{kind}]")
    if protect_ids:
        out = F.translate(out, private, "0123456789")
    return F.when(text.rlike(_HINT), out).otherwise(text)


def found_families(text: Column, families: tuple[str, ...] = tuple(PHI_PATTERNS)) -> Column:
    """The families that hit, sorted."""
    each = [F.when(text.rlike(unicode_words(PHI_PATTERNS[f])), F.lit(f)) for f in sorted(families)]
    return F.array_compact(F.array(*each))


def is_gated(text: Column) -> Column:
    """Whether a text has an identifier that keeps it out of an index."""
    any_hit = F.lit(False)
    for family in GATED_FAMILIES:
        any_hit = any_hit | text.rlike(unicode_words(PHI_PATTERNS[family]))
    return F.coalesce(text.rlike(_LIKELY) & any_hit, F.lit(False))
