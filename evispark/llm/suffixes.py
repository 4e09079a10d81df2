"""Suffix-array dedup on sparse suffixes: those at content-selected positions, sorted, compared and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, extended, grams, slices, sliding_min, written
from .windows import BUCKET, Removal, find, place_frame, text_key, with_stretches, without_stretches

#: Words of the shortest repeat, and of the seed that starts a retained suffix.
LEAST, SEED = 50, 12

_PLACE = np.uint64((1 << 24) - 1)


def sparse_suffixes(words: Words, size: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, seed hash, start, n, lead) of every retained suffix.

    A position is retained if its seed has the smallest hash of all seeds in some ``size`` words of the text, the
    first such position where several do; so all copies of a passage of ``size`` words retain the same place in it.
    The suffix travels with the words before it that such passages begin with: ``n`` passages begin at ``start`` and
    the words after it, and ``lead`` words of theirs stand before the suffix.
    """
    h, none = words.hashes(), np.zeros(0, np.int64)
    rows, width = words.rows(), size - seed + 1
    hashed = grams(h, seed)
    if len(hashed) < width:
        return none, none.astype(np.uint64), none, none, none
    place = np.arange(len(hashed)) - words.offsets[rows[: len(hashed)]]
    # the order is by 40 bits of the hash, then by place in the text
    ranked = (hashed & ~_PLACE) | (place.astype(np.uint64) & _PLACE)
    least = sliding_min(ranked, width)
    at = np.flatnonzero(rows[: len(least)] == rows[size - 1 : size - 1 + len(least)])  # passages within one text
    if not len(at):
        return none, none.astype(np.uint64), none, none, none
    row, start = rows[at], place[at]
    lead = ((least[at] & _PLACE) - (start.astype(np.uint64) & _PLACE) & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at + lead) != 0) | (np.diff(row) != 0) | (np.diff(at) > 1)
    begin = np.flatnonzero(new)
    return row[begin], hashed[at[begin] + lead[begin]], start[begin], np.diff(np.append(begin, len(at))), lead[begin]


def sorted_suffixes(t: pa.Table, size: int, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal passages of ``size`` words in whole buckets: sort suffixes, compare neighbours, extend to the left.

    Suffixes that share r words stand together in the sorted order, with r or more words in common between all
    neighbours. A passage that begins a words before its seed stands twice where suffixes of such an interval for
    r = size - a also have the same a words before. Without ``alone`` passages that stand once are left out.
    """
    m, lead = t.num_rows, t.column("lead").to_numpy().astype(np.int64)
    words = Words(t.column("packed").combine_chunks())
    code = words.values.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    first, count = words.offsets[:-1], words.counts
    most = int(lead.max()) if m else 0
    columns = np.arange(size)
    right = np.where(columns < (count - lead)[:, None], code[np.minimum((first + lead)[:, None] + columns, len(code) - 1)], 0)
    order = np.argsort(np.ascontiguousarray(right.astype(">u4")).view(f"S{4 * size}").ravel(), kind="stable")
    a, b = right[order[:-1]], right[order[1:]]
    same = (a == b) & (a != 0)
    common = np.concatenate([np.where(same.all(axis=1), size, np.argmin(same, axis=1)), [0]]) if m > 1 else np.zeros(m, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    left, groups = np.zeros(m, np.int64), 0  # names of equal words before the seed, as far as looked
    for back in range(min(most, size) + 1):
        if back:
            word = code[np.maximum(first + lead - back, 0)]
            _, left = np.unique(np.stack([left, word]), axis=1, return_inverse=True)
            left = left.ravel()
        need = size - back
        interval = np.zeros(m, np.int64)
        interval[order] = np.concatenate([[0], np.cumsum(common[:-1] < need)]) if m else interval
        at = np.flatnonzero((lead >= back) & (count - lead >= need))
        at = at[np.lexsort((left[at], interval[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(interval[at]) != 0) | (np.diff(left[at]) != 0)
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1 if len(at) else np.zeros(0, bool)
        keep = np.ones(len(at), bool) if alone else several
        found.append((at[keep], lead[at[keep]] - back, groups + group[keep]))
        groups += int(group[-1]) + 1 if len(at) else 0
    source, place, group = (np.concatenate(x) for x in zip(*found, strict=True))
    return source, place, group


def dedup(docs: DataFrame, size: int = LEAST, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with n_words, n_repeated, n_removed, removed (spans of words), kept_sha256 and kept_text.

    A passage of ``size`` words or more that stands at several places keeps its first, by doc_id and place in the
    text; the words of the others go, within a document as well. n_repeated counts the words that stand in any
    repeated passage, first places included. removed has [start, end) word numbers. Every document has its row. Null and
    empty texts have no words, texts shorter than ``size`` keep all, long ones are compared as a whole; an empty table
    gives no rows. Null doc_ids take no part. Rows that share a doc_id and a text are
    one place; other texts under the same doc_id are compared by their place in the text alone. kept_text is the text
    itself where nothing goes. Columns named like the result's are replaced,
    and so are row and stretches, which are used on the way.
    """
    docs = docs.drop("n_words", "n_repeated", "n_removed", "removed", "kept_sha256", "kept_text", "row", "stretches")
    held = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", text_key(F.col("text")))
    places = written(place_frame(held, lambda words: sparse_suffixes(words, size, seed)), "suffixes")
    shared = places.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    shared = written(shared, "shared-seeds")  # so that a frequent key is split where places are joined to it
    found = find(places, shared, held, size, True, sorted_suffixes, bucket)
    out = extended(
        docs.schema, "n_words long, n_repeated long, n_removed long, removed array<struct<start: int, end: int>>, kept_sha256 string, kept_text string"
    )
    return with_stretches(held, found).select(*docs.columns, "stretches").mapInArrow(_remover(size, out.names), out)


def _remover(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                r = Removal(b, size)
                kept = r.kept()
                counts = [pa.array(x, pa.int64()) for x in (r.n_words, r.n_seen, r.n_gone)]
                new = [*counts, r.spans(), r.digests(kept), r.texts(kept, b.column("text"))]
                yield pa.RecordBatch.from_arrays([*without_stretches(b), *new], names)

    return run
