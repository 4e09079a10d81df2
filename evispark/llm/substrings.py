"""Substring dedup by super-k-mers: windows that share a minimiser travel as one packed string to its bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, extended, grams, slices, sliding_min, written
from .windows import BUCKET, RUN, Removal, find, place_frame, sorted_windows, text_key, with_stretches, without_stretches

#: Words of a window, and of the k-mers whose smallest hash is its minimiser.
WINDOW, KMER = 50, 12


def super_kmers(words: Words, size: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, minimiser, start, n, 0) of every run of windows with one minimiser; start is counted from the text's first word."""
    h = words.hashes()
    least = sliding_min(grams(h, k), size - k + 1)
    rows, none = words.rows(), np.zeros(0, np.int64)
    if not len(least):
        return none, none.astype(np.uint64), none, none, none
    at = np.flatnonzero(rows[: len(least)] == rows[size - 1 : size - 1 + len(least)])  # windows of one text
    if not len(at):
        return none, none.astype(np.uint64), none, none, none
    row, value = rows[at], least[at]
    start = at - words.offsets[row]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(value) != 0) | (np.diff(at) > 1) | (np.diff(row) != 0)
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - begin[run]) % RUN == 0  # long runs of equal words are cut
    begin = np.flatnonzero(new)
    return row[begin], value[begin], start[begin], np.diff(np.append(begin, len(at))), np.zeros(len(begin), np.int64)


def repeats(docs: DataFrame, size: int = WINDOW, k: int = KMER, bucket: int = BUCKET) -> DataFrame:
    """The windows of (doc_id, row, text) that also stand in a document with a smaller doc_id, as stretches."""
    places = written(place_frame(docs, lambda words: super_kmers(words, size, k)), "super-kmers")
    # a minimiser that only one doc_id has holds no window of two
    shared = (
        places.groupBy("key")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times"))
        .filter("low < high")
        .select("key", "times")
    )
    shared = written(shared, "shared-minimisers")  # so that a frequent key is split where places are joined to it
    return find(places, shared, docs, size, False, sorted_windows, bucket)


def dedup(docs: DataFrame, size: int = WINDOW, k: int = KMER) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text.

    Words are runs of characters other than ASCII white space. Each word in a window of ``size`` words that also
    starts in a document with a smaller doc_id goes; windows are judged on the input, so what one document loses
    never saves or costs another's. Texts are compared as a whole, however long they are. kept_text is the text itself where nothing goes, else the kept words joined by one
    space; kept_sha256 is of the kept words joined by one space. Null and empty texts have no words; a text shorter
    than a window keeps all. A null doc_id is neither smaller nor larger than any: its text is kept and removes
    nothing. Rows with one doc_id do not remove one another. An empty table gives no rows. Columns named like the result's are replaced,
    and so are row and stretches, which are used on the way.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text", "row", "stretches")
    held = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", text_key(F.col("text")))
    out = extended(docs.schema, "n_words long, n_removed long, kept_sha256 string, kept_text string")
    joined = with_stretches(held, repeats(held, size, k)).select(*docs.columns, "stretches")
    return joined.mapInArrow(_remover(size, out.names), out)


def _remover(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                r = Removal(b, size)
                kept = r.kept()
                new = [pa.array(r.n_words, pa.int64()), pa.array(r.n_gone, pa.int64()), r.digests(kept), r.texts(kept, b.column("text"))]
                yield pa.RecordBatch.from_arrays([*without_stretches(b), *new], names)

    return run
