"""Mixing sources to target weights by hash thresholds read off histograms; documents are never sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, words_of, written

#: Bits of a document's hash that name its bucket, and those that split the boundary bucket.
BITS = 12
HASH_BITS = 52


def row_key(source: Column, *columns: str) -> Column:
    """A name of a row: md5 of its doc_id, source, text and other ``columns``. Only rows alike in these share one."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("doc_id"), source, F.md5("text"), *map(F.col, columns))]
    return F.md5(F.concat_ws("\x1f", *parts))


def hash_of(key: Column, copy: Column) -> Column:
    """52 bits that place a row in the mix, the same in every run; rows with one key have a number each, from 0."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, copy.cast("string"))), 1, 13), 16, 10).cast("long")


def bucket_of(h: Column, level: int) -> Column:
    """The bucket at level 0, or the cell within its bucket at level 1, 2, ..."""
    return F.shiftright(h, HASH_BITS - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size), one row per source.

    Sources by code point, null last, have the weights in turn. Targets are ``least(most * size, level * weight)``
    for the one level at which they sum to the size of all: what reshaping an excess by weight again and again
    ends in. Rows here are sources, not documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # strings compare by bytes, so by code point
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn(
        "cap", F.col("source_size") * F.lit(most)
    )
    # by rising cap per weight: if the first i are capped, the level is (all - their caps) / weights of the rest
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    fits = weighted.withColumn("ratio", ratio).withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    return fits.withColumn("chosen", F.coalesce(chosen, F.lit(0.0))).select(
        "skey", "source_size", F.least(F.col("cap"), F.col("chosen") * F.col("weight")).alias("target")
    )


def _passed(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """For each source the first cell at which the running sum passes the budget, and the budget left before it."""
    running = Window.partitionBy("skey").orderBy("cell")
    return (
        histogram.withColumn("after", F.sum("words").over(running))
        .filter("after > budget AND words > 0")
        .groupBy("skey", *keys)
        .agg(F.min(F.struct("cell", (F.col("budget") - F.col("after") + F.col("words")).alias("left"))).alias("b"))
        .select("skey", *keys, "b.cell", "b.left")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(skey, threshold, left): rows (skey, size, h) with h below the threshold fill the source's budget up to ``left``.

    One histogram of word sums by source and hash bucket finds the bucket that the budget ends in; a second one,
    over that bucket's rows alone, the cell in it. A source whose rows all fit has no row here.
    """
    cell = bucket_of(F.col("h"), 0)
    first = rows.groupBy("skey", cell.alias("cell")).agg(F.sum("size").alias("words")).join(budgets, "skey")
    # written, so that Spark knows its size: a row per source is broadcast where small and no source is one task
    ends = written(_passed(first, []).select("skey", F.col("cell").alias("bucket"), F.col("left").alias("budget")), "mix-ends")
    second = (
        rows.select("skey", "size", "h", cell.alias("bucket"))
        .join(ends, ["skey", "bucket"])
        .groupBy("skey", "bucket", "budget", bucket_of(F.col("h"), 1).alias("cell"))
        .agg(F.sum("size").alias("words"))
    )
    at = F.shiftleft(F.col("bucket").cast("long"), BITS) + F.col("cell")
    return _passed(second, ["bucket"]).select("skey", F.shiftleft(at, HASH_BITS - 2 * BITS).alias("threshold"), "left")


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with what decides about a row: skey (its source), size (words) and key (its name, see row_key)."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return docs.withColumns({"skey": skey, "size": F.size(words_of(F.col("text"))).cast("long"), "key": row_key(skey, *columns)})


def sizes(rows: DataFrame) -> DataFrame:
    """(doc_id, source, skey, size, key, times, copy, h): ``measured`` rows without text. Rows that are alike in all
    are counted, and as many are made again with a number each, so that they have hashes of their own."""
    counted = rows.groupBy("doc_id", "source", "skey", "size", "key").agg(F.count("*").alias("n")).withColumn("times", F.col("n"))
    return spread(counted, "n", "copy").withColumn("h", hash_of(F.col("key"), F.col("copy")))


def plan(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, fills: int = 3) -> DataFrame:
    """For each source: source_size, target, rounds (whole copies of all), and threshold{k} and gap{k} of its rest.

    ``sized``: (skey, source, size, h), a table that is cheap to read again and again.
    """
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("rounds") * F.col("source_size")
    out = written(targets(sources, weights, most).withColumn("rounds", rounds).withColumn("gap0", rest), "mix-plan")
    for k in range(fills + 1):
        rows = sized.join(out, "skey").filter((F.col("size") <= F.col(f"gap{k}")) & ~_chosen(k)) if k else sized
        found = thresholds(rows.select("skey", "size", "h"), out.select("skey", F.col(f"gap{k}").alias("budget")))
        # without a threshold all rows fit, and no row is left to fill what remains
        found = found.select("skey", F.col("threshold").alias(f"threshold{k}"), F.col("left").alias(f"gap{k + 1}"))
        out = written(
            out.join(found, "skey", "left").fillna({f"threshold{k}": 1 << HASH_BITS, f"gap{k + 1}": 0.0}), "mix-plan"
        )
    return out


def _chosen(levels: int) -> Column:
    """Whether a row is in its source's rest, by the first ``levels`` thresholds."""
    out = F.lit(False)
    for k in range(levels):
        below = (F.col("h") < F.col(f"threshold{k}")) & (F.col(f"gap{k}") > 0)
        out = out | ((below & (F.col("size") <= F.col(f"gap{k}"))) if k else below)
    return out


def copies(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows of ``sizes`` with source_size, target and copies, as ``plan`` has it for their sources."""
    levels = sum(c.startswith("threshold") for c in by_source.columns)
    extra = [c for c in by_source.columns if c.startswith(("threshold", "gap")) or c == "rounds"]
    n = (F.col("rounds") + _chosen(levels).cast("long")).cast("long")
    return sized.join(by_source, "skey").withColumn("copies", n).drop(*extra)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, fills: int = 3) -> DataFrame:
    """Every document with the words that the mix takes of it: 0, its size, or up to ``most`` times its size.

    Returns doc_id, size, source_size, target, taken and copies. A source's target is so many whole rounds over it
    and a rest; the rest takes the documents whose hash is under the source's threshold, so a smaller budget takes a
    subset of what a larger one takes. The threshold leaves a gap of less than the next cell's documents; it is
    closed ``fills`` times in the same way, among documents not yet taken that are no larger than the gap.

    Null texts have size 0; a null source is one of its own; the hash is of doc_id, source, text and, for rows that are
    alike in these, a number, so rows with one doc_id or none are chosen one by one; a long text is one document of its
    size; an empty table gives no rows; other columns are not read. Sources are grouped only after
    partial sums, so a source with a third of the rows is no burden; tables with a row per source are not broadcast
    unless Spark has measured them.
    """
    sized = written(sizes(measured(docs.select("doc_id", "source", "text"))), "mix-sizes")  # holds no text
    return copies(sized, plan(sized, weights, most, fills)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, fills: int = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it does (see ``mix``).

    A row's own hash decides, so texts are not shuffled; rows that are alike in all columns are decided about together,
    and one of them is repeated as often as all of them are taken. ``docs`` needs doc_id, source and text.
    """
    # the row travels as a struct, so that names of other columns clash with none here
    others = [f"mine.`{c}`" for c in docs.columns if c not in ("doc_id", "source", "text")]
    rows = measured(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("mine")), *others)
    sized = written(sizes(rows), "mix-sizes")
    by_source = plan(sized, weights, most, fills)
    alike = copies(sized.filter("times > 1"), by_source).groupBy("key").agg(F.sum("copies").alias("all_copies"))
    marked = rows.join(written(alike, "mix-alike"), "key", "left")  # few keys, which Spark broadcasts by their size
    alone = marked.filter("all_copies IS NULL").withColumns({"copy": F.lit(0), "h": hash_of(F.col("key"), F.lit(0))})
    single = copies(alone, by_source).select("mine", "copies")
    several = marked.filter("all_copies > 0").dropDuplicates(["key"]).select("mine", F.col("all_copies").alias("copies"))
    return spread(single.unionAll(several), "copies", "copy").select("mine.*")
