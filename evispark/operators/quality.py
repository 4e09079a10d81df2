"""Quality gate: graded checks, a report for each batch, a verdict, and the split into clean and rejected rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import policy
from ..functions.text import blank
from ..scratch import lent, scratch

FATAL, ADVISORY = "FATAL", "ADVISORY"
#: Words of 64 rows, of which some are duplicates, that are broadcast: some 50 MB, and enough for 67 million rows.
MARKED = 1 << 20


class BatchHalted(RuntimeError):
    """The share of fatal rows in a batch is over the threshold."""


@dataclass(frozen=True)
class Check:
    """``predicate`` is true where the row violates; null counts as false."""

    name: str
    code: str
    severity: str
    predicate: Column


@dataclass(frozen=True)
class Gate:
    """Checks over one kind of record. ``key`` must be unique; the first by ``order`` keeps it."""

    key: str
    checks: Callable[[Column], list[Check]]


def duplicate_of_earlier(df: DataFrame, key: str, order: str, name: str = "_duplicate", ever: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: whether a row with the same key comes earlier. Null keys equal one another; rows that tie for
    the first place are all first.

    ``ever`` (_key, _ever) says how often each key has come so far, ``df`` included; a key that has come more often than it
    stands in ``df`` has come before.

    Keys that stand more than once are found first and written aside; there are few, so that Spark broadcasts them by
    their size and rows are not shuffled. Keys are grouped after partial sums, so a hot key (nulls, say) is no task's work.
    """
    repeated = scratch(_repeated(df, key, order, ever), "repeated")
    joined = df.join(repeated, df[key].eqNullSafe(repeated["_k"]), "left")
    return joined.withColumn(name, F.coalesce(F.col("_before") | (F.col(order) > F.col("_first")), F.lit(False))).drop("_k", "_first", "_before")


def _repeated(df: DataFrame, key: str, order: str, ever: DataFrame | None) -> DataFrame:
    """(_k, _first, _before): keys that stand more than once in ``df``, or have come before it."""
    counted = df.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"), F.count("*").alias("_times"))
    before = F.lit(False)
    if ever is not None:
        counted = counted.join(ever, F.col("_k").eqNullSafe(F.col("_key")), "left")
        before = F.coalesce(F.col("_ever") > F.col("_times"), F.lit(False))
    return counted.withColumn("_before", before).filter("_times > 1 OR _before").select("_k", "_first", "_before")


def numbered_duplicates(df: DataFrame, key: str, order: str, number: str, name: str = "_duplicate", ever: DataFrame | None = None) -> DataFrame:
    """As duplicate_of_earlier for rows that are written with a ``number`` each (0 or more, all different; it goes), however many
    keys stand more than once.

    Only numbers, keys and order are joined with the keys. What comes of it is a bit for each row, 64 to a word, which is
    broadcast up to MARKED words, so that whole rows stay where they are; over that Spark chooses the join.
    """
    with lent(_repeated(df, key, order, ever), "repeated") as repeated:
        again = df.select(*{number, key, order}).join(repeated, F.col(key).eqNullSafe(F.col("_k"))).filter(F.col("_before") | (F.col(order) > F.col("_first")))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(number))
        words = scratch(again.groupBy(F.shiftright(number, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "again")
    few = words.count() <= MARKED
    joined = df.join(F.broadcast(words) if few else words, F.shiftright(number, 6) == F.col("_word"), "left")
    return joined.withColumn(name, F.coalesce(F.bit_get("_bits", _place(number)) == 1, F.lit(False))).drop(number, "_word", "_bits")


def _place(number: str) -> Column:
    """A row's place in its word of 64."""
    return F.col(number).bitwiseAND(63).cast("int")


def trial_gate(as_of: str) -> Gate:
    """Checks of registry trials; ``as_of`` (yyyy-MM-dd) is the day that staleness counts from."""

    def checks(duplicate: Column) -> list[Check]:
        low, high, enrolled = (F.col(c).try_cast("double") for c in ("min_age_years", "max_age_years", "enrollment"))
        false = F.lit(False)
        impossible = [low < 0, low > 120, high < 0, high > 120, low > high, enrolled < 0]
        any_impossible = false
        for x in impossible:
            any_impossible = any_impossible | F.coalesce(x, false)
        day = F.coalesce(F.try_to_date("last_update", "yyyy-MM-dd"), F.try_to_date("last_update", "yyyy-MM"))
        status = F.upper(F.coalesce("overall_status", F.lit("")))
        return [
            Check("completeness_identity", "MISSING_IDENTITY", FATAL, F.col("nct_id").isNull() | blank(F.col("brief_title"))),
            Check("completeness_summary", "MISSING_SUMMARY", ADVISORY, blank(F.col("brief_summary"))),
            Check("validity_nct_id_format", "INVALID_NCT_ID", FATAL, ~F.coalesce("nct_id", F.lit("")).rlike(policy.NCT_ID)),
            Check("uniqueness_nct_id", "DUPLICATE_NCT_ID", FATAL, duplicate),
            Check("accuracy_numeric_ranges", "IMPOSSIBLE_NUMERIC_VALUE", FATAL, any_impossible),
            Check("consistency_status_vocabulary", "UNKNOWN_STATUS_VALUE", ADVISORY, ~status.isin(*policy.TRIAL_STATUSES)),
            Check("timeliness_last_update", "STALE_RECORD", ADVISORY, day < F.date_sub(F.lit(as_of).cast("date"), 1825)),
        ]

    return Gate("nct_id", checks)


def literature_gate(year: int) -> Gate:
    """Checks of articles; ``year`` is the current one."""

    def checks(duplicate: Column) -> list[Check]:
        published = F.col("pub_year").try_cast("double")
        kinds = F.lower(F.coalesce("publication_types", F.lit("")))
        known = F.lit(False)
        for kind in policy.EVIDENCE_TYPES:
            known = known | kinds.contains(kind)
        return [
            Check("completeness_identity", "MISSING_IDENTITY", FATAL, F.col("pmid").isNull() | blank(F.col("title"))),
            Check("completeness_abstract", "MISSING_ABSTRACT", ADVISORY, blank(F.col("abstract"))),
            Check("validity_pmid_format", "INVALID_PMID", FATAL, ~F.coalesce("pmid", F.lit("")).rlike(policy.PMID)),
            Check("uniqueness_pmid", "DUPLICATE_PMID", FATAL, duplicate),
            Check("accuracy_publication_year", "IMPOSSIBLE_PUBLICATION_YEAR", FATAL, (published < 1800) | (published > year + 1)),
            Check("consistency_publication_type", "UNRECOGNISED_PUBLICATION_TYPE", ADVISORY, ~known),
            Check("timeliness_publication_year", "DATED_EVIDENCE", ADVISORY, published < year - 10),
        ]

    return Gate("pmid", checks)


def grade(df: DataFrame, gate: Gate, order: str = "seq", ever: DataFrame | None = None, number: str | None = None) -> DataFrame:
    """``df`` with quality_failures and data_quality_flags: codes of violated checks, in order, joined by ``|``.

    ``ever`` tells of rows that came before ``df``, see duplicate_of_earlier; ``number`` is the column of rows that are written
    with numbers, see numbered_duplicates."""
    marked = numbered_duplicates(df, gate.key, order, number, ever=ever) if number else duplicate_of_earlier(df, gate.key, order, ever=ever)
    checks = gate.checks(F.col("_duplicate"))

    def codes(severity: str) -> Column:
        return F.array_join(F.array(*[F.when(c.predicate, F.lit(c.code)) for c in checks if c.severity == severity]), "|")

    return marked.withColumns({"quality_failures": codes(FATAL), "data_quality_flags": codes(ADVISORY)}).drop("_duplicate")


def clean_rows(graded: DataFrame) -> DataFrame:
    return graded.filter(F.col("quality_failures") == "").drop("quality_failures")


def rejected_rows(graded: DataFrame) -> DataFrame:
    return graded.filter(F.col("quality_failures") != "").drop("data_quality_flags")


def _counts(gate: Gate | None = None) -> list[Column]:
    """What report and verdict need to know, as aggregates over graded rows."""
    fatal, flagged = F.col("quality_failures") != "", F.col("data_quality_flags") != ""
    of_batch = {"evaluated": F.count(F.lit(1)), "rejected": F.count_if(fatal), "clean": F.count_if(~fatal), "advisory_flagged": F.count_if(~fatal & flagged), "_any": F.count_if(fatal | flagged)}
    codes = {FATAL: "quality_failures", ADVISORY: "data_quality_flags"}
    of_checks = {c.name: F.count_if(F.array_contains(F.split(codes[c.severity], r"\|"), c.code)) for c in (gate.checks(F.lit(False)) if gate else [])}
    return [c.alias(n) for n, c in (of_batch | of_checks).items()]


def _verdict(counted: DataFrame, threshold: float) -> DataFrame:
    ratio = F.when(F.col("evaluated") > 0, F.col("rejected") / F.col("evaluated")).otherwise(F.lit(0.0))
    shown = [F.bround(ratio, 4).alias("fatal_ratio"), (F.col("_any") == 0).alias("passed_all_gates"), (ratio > threshold).alias("halt_pipeline")]
    return counted.select("evaluated", "rejected", "clean", "advisory_flagged", *shown)


def _report(counted: DataFrame, gate: Gate) -> DataFrame:
    checks = gate.checks(F.lit(False))
    each = [F.struct(F.lit(c.name).alias("metric"), F.col(c.name).alias("violations"), F.lit(c.severity).alias("severity")) for c in checks]
    return counted.select(F.explode(F.array(*each)).alias("r")).select("r.*", F.when(F.col("r.violations") > 0, "FAILED").otherwise("PASSED").alias("status"))


def report(graded: DataFrame, gate: Gate) -> DataFrame:
    """(metric, violations, severity, status), a row for each check, from one pass over the graded rows."""
    return _report(graded.agg(*_counts(gate)), gate)


def verdict(graded: DataFrame, threshold: float = 0.30) -> DataFrame:
    """One row: counts, fatal_ratio (4 decimals), passed_all_gates, and halt_pipeline (unrounded ratio over the threshold)."""
    return _verdict(graded.agg(*_counts()), threshold)


@dataclass(frozen=True)
class Graded:
    """Graded rows that are written, with the verdict and the report that writing them has counted."""

    rows: DataFrame
    verdict: DataFrame
    report: DataFrame


@contextmanager
def graded_once(df: DataFrame, gate: Gate, order: str = "seq", threshold: float = 0.30, ever: DataFrame | None = None) -> Iterator[Graded]:
    """Grade rows and write them aside for as long as the block lasts; what is known of the batch is counted on the way, so
    nothing is read for it again."""
    seen = Observation()
    with lent(grade(df, gate, order, ever).observe(seen, *_counts(gate)), "graded") as rows:
        counts = seen.get
        kind = ", ".join(f"`{n}` long" for n in counts)
        counted = df.sparkSession.createDataFrame([tuple(counts.values())], kind)  # one row
        yield Graded(rows, _verdict(counted, threshold), _report(counted, gate))


def enforce(verdict_row: DataFrame) -> None:
    """Raise if the batch is to halt."""
    row = verdict_row.first()
    if row["halt_pipeline"]:
        raise BatchHalted(f"{row['rejected']} of {row['evaluated']} rows are fatal")
