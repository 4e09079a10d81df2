"""Text functions on columns, all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy

#: What Unicode calls white space; Python's own strip() takes four control characters more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; a text that has none there is not searched for it."""
    return F.when(F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def exploded(df: DataFrame, array: str | Column, *names: str) -> DataFrame:
    """``df`` with a row for each element of an array that isn't null: (element) or (position, element) in the columns ``names``.

    With explode Spark asks for the array's size in a filter below it, and computes the array again for that (twice, for null
    as well); an outer one has no such filter.
    """
    outer = F.explode_outer if len(names) == 1 else F.posexplode_outer
    return df.select("*", outer(array).alias(*names)).filter(F.col(names[-1]).isNotNull())


def blank(c: Column) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def tokenize(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def parse_age_years(c: Column) -> Column:
    """Years of texts such as ``18 Years`` or ``6 Months``, two decimals, halves to even; else null."""
    number = F.regexp_extract(strip(c), policy.AGE, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(strip(c), policy.AGE, 2))
    years = F.when(unit == "year", 1.0).when(unit == "month", 1 / 12).when(unit == "week", 1 / 52).when(unit == "day", 1 / 365)
    return F.bround(number * years, 2)


def number_text(c: Column, absent: str) -> Column:
    """A number with six significant digits and no trailing zeros; ``absent`` for null and NaN."""
    short = F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+($|e)", "$1$2")
    return F.when(c.isNull() | F.isnan(c), F.lit(absent)).otherwise(F.regexp_replace(short, r"\.($|e)", "$1"))


def first_hex(c: Column, digits: int) -> Column:
    return F.upper(F.substring(c, 1, digits))


def pseudonymise(c: Column, salt: str, digits: int = 10) -> Column:
    """``PATIENT_`` and the first hex digits of the salted SHA-256; null stays null. The same text and salt always
    give the same pseudonym; with 10 digits, collisions are likely from about a million patients on."""
    return F.concat(F.lit("PATIENT_"), first_hex(F.sha2(F.concat(F.lit(salt), c), 256), digits))
