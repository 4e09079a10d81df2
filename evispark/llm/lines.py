"""Line dedup: hashes of lines in ranges, sorted by document and place, stream past their first document; native.

What comes back for each document is a keep bitmap, compressed to the lengths of its runs of kept and dropped lines in turn,
beginning with kept ones ([0, 2, 5]: two lines go, five stay). Texts meet it in one join at the end.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import exploded
from .common import written
from .windows import text_key

#: White space that a line's key has at neither end: that between words.
EDGES = " \t\n\x0b\x0c\r"
#: Code points that a key has at least, else its lines always stay.
LEAST = 10
#: A key with over 1 / (HOT * partitions) of all lines is dealt to several parts; fewer than HOT * partitions can have that.
HOT = 4
#: A key with fewer lines is never dealt.
PART = 64


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """A line without white space at both ends, a-z for A-Z and nothing else lower-cased."""
    cut = F.trim(line, F.lit(EDGES))
    exact = F.translate(cut, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(cut) == F.length(cut), F.lower(cut)).otherwise(exact)  # lower() is quicker and the same in ASCII


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line of (doc_id, row, text) with a key of ``least`` code points; 128 bits name a key."""
    whole = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row", "text")
    lines = exploded(whole, lines_of(F.col("text")), "pos", "line")  # not split again for a filter
    keyed = lines.select("doc_id", "row", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= least)
    return keyed.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "doc_id", "row", "pos")


def hot_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, parts, head): keys with too many lines for one task, into how many parts to deal each, and its smallest doc_id.

    Counts by ranges of hashes find where such keys can be; only keys there are counted one by one, after partial sums.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(PART, lines.count() // (HOT * tasks))
    cell = F.pmod("h1", F.lit(16 * tasks)).alias("cell")
    crowded = written(lines.groupBy(cell).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("cell"), "crowded")
    near = lines.withColumn("cell", cell).join(crowded, "cell", "left_semi")
    counted = near.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).filter(F.col("n") > most)
    return counted.select("h1", "h2", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("parts"), "head")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, row, pos) of the lines whose key stands in a smaller doc_id too.

    Hashes are range-partitioned and sorted by document and position within each key, so a line is dropped if the first
    that streamed by has a smaller doc_id. A hot key has a range for each of its parts, which all begin with its head.
    """
    hot = written(hot_keys(lines), "hot-lines")  # small, as HOT says; Spark broadcasts it by its size
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "row", "pos"), "parts"), F.lit(0)).cast("int")
    dealt = lines.join(hot, ["h1", "h2"], "left").select("h1", "h2", part.alias("part"), "doc_id", "row", "pos", "head")
    ranged = dealt.repartitionByRange("h1", "h2", "part")
    stream = Window.partitionBy("h1", "h2", "part").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.least(F.first("doc_id").over(stream), F.col("head"))  # least() passes over nulls
    return ranged.select("doc_id", "row", "pos", first.alias("first")).filter("first < doc_id").select("doc_id", "row", "pos")


def run_starts(sorted_places: str) -> Column:
    """Those of an array of sorted numbers that do not follow the one before."""
    x = F.col(sorted_places)
    return F.filter(x, lambda p, i: (i == 0) | (F.get(x, i - 1) < p - 1))


def run_ends(sorted_places: str) -> Column:
    """One more than those of an array of sorted numbers that the next does not follow."""
    x = F.col(sorted_places)
    return F.transform(F.filter(x, lambda p, i: (i == F.size(x) - 1) | (F.get(x, i + 1) > p + 1)), lambda p: p + 1)


def gone_runs(dropped: DataFrame) -> DataFrame:
    """(doc_id, row, gone): [start, end) of each run of dropped lines, for documents that lose any."""
    held = dropped.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # as many as a text has lines
    runs = held.select("doc_id", "row", run_starts("at").alias("starts"), run_ends("at").alias("ends"))
    return runs.select("doc_id", "row", F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end"))).alias("gone"))


def kept_runs(n_lines: Column, gone: Column) -> Column:
    """[start, end) of each run of lines that stay between the runs ``gone``; the first and the last may be empty."""
    starts = F.concat(F.array(F.lit(0)), gone["end"])
    ends = F.concat(gone["start"], F.array(n_lines.cast("int")))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def keep_bitmap(n_lines: Column, gone: Column) -> Column:
    """The compressed bitmap: lengths of runs of kept and dropped lines in turn; no run at the end is empty."""
    lengths = F.flatten(
        F.zip_with(
            kept_runs(n_lines, gone), gone, lambda k, g: F.when(g.isNull(), F.array(k["end"] - k["start"])).otherwise(F.array(k["end"] - k["start"], g["end"] - g["start"]))
        )
    )
    return F.when(F.element_at(lengths, -1) == 0, F.slice(lengths, F.lit(1), F.size(lengths) - 1)).otherwise(lengths)


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep (the compressed bitmap, see above), kept_text and kept_sha256.

    A text is split at newlines; null and empty ones are one empty line. A line's key is the line without ASCII white space
    at both ends, with A-Z lower-cased. Keys of ``least`` code points or more that several doc_ids have lose all their
    lines but those in the smallest doc_id. kept_text is what stays, joined by newlines (of a null text, an empty one).

    Whole texts are read, however long; a document's lines are in one task only when its bitmap meets its text. Rows that
    share a doc_id drop nothing from one another; repeated rows get equal results. A null doc_id is neither smaller nor
    larger than any: its lines stay and drop nothing. An empty table gives no rows. Columns named like the result's are
    replaced, and so are row, gone and lines, which are used on the way.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep", "kept_text", "kept_sha256", "row", "gone", "lines")
    held = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", text_key(F.col("text")))
    lines = written(line_hashes(held.select("doc_id", "row", "text"), least), "lines")
    gone = gone_runs(dropped_lines(lines))
    # runs are small beside texts, so these are hashed where texts stream by, and no text is sorted
    joined = held.join(gone.hint("shuffle_hash"), ["doc_id", "row"], "left")
    none = F.array().cast("array<struct<start: int, end: int>>")
    cut = joined.withColumns({"gone": F.coalesce("gone", none), "lines": lines_of(F.col("text"))}).withColumn("n_lines", F.size("lines").cast("long"))
    kept = F.flatten(F.transform(kept_runs(F.col("n_lines"), F.col("gone")), lambda r: F.slice("lines", r["start"] + 1, r["end"] - r["start"])))
    text = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["end"] - g["start"])
    out = cut.select(*docs.columns, "n_lines", n_dropped.alias("n_dropped"), keep_bitmap(F.col("n_lines"), F.col("gone")).alias("keep"), text.alias("kept_text"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256))
