"""Document fingerprints: the k smallest hashes of a text's shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, words_of, written

#: Words in a shingle, hashes in a sketch.
WORDS = 5
K = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Hash of every n words in a row; of all words together where there are fewer; none without words."""

    def of(hashed: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(1), F.size(hashed) - (n - 1)), lambda i: F.xxhash64(F.slice(hashed, i, n)))
        few = F.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(hashed) >= n, rolled).otherwise(few)

    return _let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of)


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together, from their sketches alone."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch for each key from those of its parts.

    Hashes are made distinct first, which combines before the shuffle, and each key's k smallest are kept in every
    task before they meet, so a key with a third of all parts is not gathered anywhere.
    """
    one = df.select(key, F.explode(column).alias("_hash")).distinct()
    rank = Window.partitionBy(key).orderBy("_hash")
    least = one.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of both texts' shingles that are in either; 1 for two empty sketches."""

    def of(both: Column) -> Column:
        share = F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.greatest(F.size(both), F.lit(1))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(share)

    return _let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    spread = (F.try_element_at(a, F.lit(k)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    j = resemblance(a, b, k)
    common = j * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _numbers(values: list[int]) -> Column:
    """A constant array of longs, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _place(points: list[tuple[int, int]], order: Column, tie: Column) -> Column:
    """How many of the sorted split ``points`` (order, tie) are at or before a row: a binary search in built-in functions."""
    if not points:
        return F.lit(0)
    orders, ties = _numbers([p for p, _ in points]), _numbers([t for _, t in points])
    steps = [1 << i for i in range(len(points).bit_length() - 1, -1, -1)]

    def step(at: Column, by: Column) -> Column:
        o, t = F.get(orders, at + by - 1), F.get(ties, at + by - 1)  # null beyond the last
        return F.when((o < order) | ((o == order) & (t <= tie)), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


#: Rows that are looked at for each split point.
SAMPLED = 16


def beside_next(docs: DataFrame, parts: int = 64) -> DataFrame:
    """Rows (doc_id, text, tie, ...) with a struct ``next``: the (text, sk) of the row after in descending doc_id, after
    the last the first's.

    Ties go by the text's hash, null doc_ids come last. The order by (doc_id, hash) is cut in about ``parts`` ranges of
    equal numbers of rows, more with more shuffle partitions, by split points from some SAMPLED rows for each; rows find
    their range by binary search. Each range also gets the first row of the next one that has rows, so no window
    spans the table, and rows with one doc_id or none spread over ranges. Rows alike in doc_id and text are counted
    first: one of them stands in the order, the others are their own next rows.
    """
    spark = docs.sparkSession
    parts = max(parts, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ascending in both: ~x falls as x rises and never overflows; the lowest value of all (so, the last) for null
    order = F.when(F.col("doc_id").isNull(), F.lit(2**63 - 1)).otherwise(F.bitwise_not("doc_id"))
    keys = docs.select(order.alias("order"), "tie")
    counted = written(keys.groupBy("order", "tie").agg(F.count("*").alias("times")), "order")
    n = counted.count()
    every = max(1, n // (SAMPLED * parts))
    drawn = counted.filter(F.pmod(F.xxhash64("order", "tie"), F.lit(every)) == 0).select("order", "tie")
    sample = sorted((r["order"], r["tie"]) for r in drawn.collect())  # some SAMPLED * parts rows of two numbers
    points = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    part = _place(points, F.col("order"), F.col("tie"))
    top = counted.select(part.alias("part"), F.struct("order", "tie").alias("key")).groupBy("part").agg(F.min("key").alias("head"))
    heads = sorted((r["part"], r["head"]["order"], r["head"]["tie"]) for r in top.collect())  # a row for each range
    # the first row of a range is read by the range before it as well; that of the first by the last
    at = {p: i for i, (p, _, _) in enumerate(heads)}
    before = [heads[at[p] - 1][0] if p in at else -1 for p in range(len(points) + 1)]
    head = {p: (o, t) for p, o, t in heads}
    first = [head.get(p, (0, 0)) for p in range(len(points) + 1)]
    is_head = (F.get(_numbers([o for o, _ in first]), F.col("part")) == F.col("order")) & (F.get(_numbers([t for _, t in first]), F.col("part")) == F.col("tie"))

    repeated = written(counted.filter("times > 1"), "order-repeated")  # Spark broadcasts it by its size
    held = docs.withColumn("order", order)
    marked = held.join(repeated, ["order", "tie"], "left") if not repeated.isEmpty() else held.withColumn("times", F.lit(None).cast("long"))
    several = marked.filter("times IS NOT NULL").dropDuplicates(["order", "tie"])
    alike = spread(several.withColumn("times", F.col("times") - 1), "times", "copy").withColumn("next", F.struct("text", "sk"))
    placed = marked.filter("times IS NULL").unionAll(several).withColumn("part", part)
    own = F.struct("part", F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(_numbers(before), F.col("part")).cast("int").alias("part"), F.lit(True).alias("ghost"))
    stood = placed.withColumn("c", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own)))).drop("part").select("*", "c.part", "c.ghost")
    within = Window.partitionBy("part").orderBy("ghost", "order", "tie")
    following = stood.withColumn("next", F.lead(F.struct("text", "sk")).over(within)).filter(~F.col("ghost"))
    return following.select(*docs.columns, "next").unionAll(alike.select(*docs.columns, "next"))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document's fingerprint and that of its edited text, with their likeness and that to the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. A null text is an empty one; empty texts have the empty fingerprint, and two of them are alike (1).
    Rows that share doc_id and text are one another's next in any order, which gives the same results; those that
    share doc_id alone go by a hash of the text, null doc_ids come last. A text has as many hashes as shingles while it
    is in hand, whatever its length. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).withColumn("sk", sketch(shingle_hashes(F.col("text")), k))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.coalesce("next.text", "text"), F.lit(1), half),
    )
    return (
        beside_next(own)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_sk", sketch(shingle_hashes(F.col("edited")), k))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            as_text(F.col("sk")).alias("fingerprint"),
            as_text(F.col("edited_sk")).alias("edited_fingerprint"),
            resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
            resemblance(F.col("sk"), F.coalesce("next.sk", "sk"), k).alias("near_next"),
            distinct_shingles(F.col("sk"), k).alias("n_shingles_estimate"),
        )
    )
