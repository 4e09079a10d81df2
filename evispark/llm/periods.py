"""Periodic runs of words by bit-parallel lags: bit planes of word ids as big integers, shifted, compared and thinned out.

A *run* is a stretch of consecutive words with smallest period q and a length of max(6, 4 q) or more that cannot be
extended. Planes of a slice of documents are searched for the short lags at once; a longer lag is looked at in a document
only where two equal grams stand so far apart on a grid that no run of that period avoids.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, extended, grams, slices, words_of

#: Words that a run has at least, and periods that go into its length at least.
LEAST, TIMES = 6, 4
#: Lags that a whole slice is searched for; the grams that longer ones are looked for by have as many words.
SHORT = 8
#: Grid points that are compared at once.
POINTS = 1 << 20

_RUN = "struct<start: long, length: long, period: long>"


def planes(ids: np.ndarray) -> list[int]:
    """Bit planes of numbers from 0: bit i of plane k is bit k of ids[i]."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def stretches(alike: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each stretch of ``least`` or more one bits. Doubled shifts and ANDs leave a bit for each place
    that so many ones follow; the loop ends as soon as none is left."""
    x, width = alike, 1
    while x and width < least:
        step = min(width, least - width)
        x &= x >> step
        width += step
    if x:
        begin, end = (_places(b) for b in (x & ~(x << 1), x & ~(x >> 1)))
        yield from zip(begin.tolist(), (end - begin + least).tolist(), strict=True)


def _places(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    at = np.flatnonzero(raw)  # most bytes are empty
    rows, cols = np.nonzero(np.unpackbits(raw[at, None], axis=1, bitorder="little"))
    return at[rows] * 8 + cols


def at_lag(bits: list[int], n: int, lag: int, apart: int = 0) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of n words that have the period ``lag`` for max(LEAST, TIMES * lag) words or more.
    ``apart`` has a bit for each word that is not to be compared with the one ``lag`` later."""
    if n <= lag:
        return
    unlike = apart
    for plane in bits:
        unlike |= plane ^ (plane >> lag)
    least = max(LEAST - lag, (TIMES - 1) * lag)
    for start, length in stretches(~unlike & ((1 << (n - lag)) - 1), least):
        yield start, length + lag


def short_runs(ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, length, lag) for lags up to SHORT in all texts of a slice at once; texts begin at ``offsets``."""
    n, bits = len(ids), planes(ids)
    ends = np.unique(offsets[1:-1])
    for lag in range(1, SHORT + 1):
        apart = np.zeros(n, np.uint8)
        for k in range(1, lag + 1):  # the last words of a text have no partner in it
            apart[ends[ends >= k] - k] = 1
        edge = int.from_bytes(np.packbits(apart, bitorder="little").tobytes(), "little")
        for start, length in at_lag(bits, n, lag, edge):
            text = int(np.searchsorted(offsets, start, "right")) - 1
            yield text, start - int(offsets[text]), length, lag


def long_lags(hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, lag, places) of lags over SHORT that a text can have a run of, in order.

    A run of period q has (TIMES - 1) q words, one after another, that equal the word q later, so as many less SHORT - 1
    grams of SHORT words that equal the gram q later. A grid of that width has a point among them.
    """
    size = np.diff(offsets)
    lags = np.maximum(size // TIMES - SHORT, 0)
    gram = grams(hashes, SHORT)
    text = np.repeat(np.arange(len(size)), lags)
    lag = np.arange(len(text)) - np.repeat(np.cumsum(lags) - lags, lags) + SHORT + 1
    width = (TIMES - 1) * lag - SHORT + 1
    points = (size[text] - lag - SHORT) // width + 1  # of the gram and of that ``lag`` later
    chunk = np.cumsum(points) // POINTS
    for c in range(int(chunk[-1]) + 1 if len(chunk) else 0):
        mine = slice(*np.searchsorted(chunk, [c, c + 1]))
        pair = np.repeat(np.arange(mine.start, mine.stop), points[mine])
        k = np.arange(len(pair)) - np.repeat(np.cumsum(points[mine]) - points[mine], points[mine])
        at = k * width[pair]
        here = offsets[text[pair]] + at
        hit = np.flatnonzero(gram[here] == gram[here + lag[pair]])
        first = np.flatnonzero(np.diff(pair[hit], prepend=-1))
        for a, b in itertools.pairwise([*first.tolist(), len(hit)]):
            p = pair[hit[a]]
            yield int(text[p]), int(lag[p]), at[hit[a:b]]


def find_runs(words: Words) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period."""
    coded = words.values.dictionary_encode()
    ids, offsets = coded.indices.to_numpy().astype(np.int64), np.asarray(words.offsets, np.int64)
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(offsets) - 1)]
    for text, start, length, lag in short_runs(ids, offsets):
        found[text].setdefault((start, length), lag)  # the smallest period comes first, others are its multiples
    current, bits = -1, []
    for text, lag, places in long_lags(words.hashes(), offsets):
        for (start, length), period in found[text].items():  # what a run of a divisor explains: no other begins there
            if lag % period == 0 and len(places):
                places = places[(places < start) | (places >= start + length - lag)]
        if len(places):
            if text != current:
                current, own = text, np.unique(ids[offsets[text] : offsets[text + 1]], return_inverse=True)[1]
                bits = planes(own)
            for start, length in at_lag(bits, len(own), lag):
                found[text].setdefault((start, length), lag)
    return [sorted((s, n, q) for (s, n), q in f.items()) for f in found]


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period of each, by start and period), collapsed_text (a word goes if any run
    has it after its first period; the others are joined by one space) and collapsed_sha256.

    Words are runs of characters other than ASCII white space; null and blank texts have none. Texts are searched as a
    whole, however long, each row alone: nothing is shuffled, doc_id is not read, copies and repeated rows get equal
    results. Of a stretch with several periods the smallest counts. An empty table gives no rows; columns named like the
    result's are replaced.
    """
    docs = docs.drop("n_words", "runs", "collapsed_text", "collapsed_sha256")
    out = extended(docs.schema, f"n_words long, runs array<{_RUN}>, collapsed_text string, collapsed_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                words = Words(b.column("text"))
                runs = find_runs(words)
                marks = np.zeros(len(words) + 1, np.int64)
                for at, mine in zip(words.offsets.tolist(), runs, strict=False):
                    for start, length, period in mine:
                        marks[at + start + period] += 1
                        marks[at + start + length] -= 1
                keep = np.cumsum(marks[:-1]) == 0
                counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.offsets])
                text = words.joined(words.values.filter(pa.array(keep)), counts)
                flat = [r for mine in runs for r in mine]
                parts = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"])
                )
                digests = pa.array([hashlib.sha256(t).hexdigest() for t in text.cast(pa.large_binary()).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words.counts, pa.int64()), lists, text.cast(pa.string()), digests], out.names)

    return docs.mapInArrow(run, out)


def looped(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end, in one of ten documents by a checksum of their doc_id; others as they are.

    Of n words, those from ``a`` on repeat the first p of them: a = g % n, p = 1 + (n - a) / (3 + g % 8) for the tenth part g of
    the checksum. A null doc_id has none, so its text stays.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(x: Column) -> Column:
        n = F.size(x["w"])
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(places, " ")).otherwise(text)

    # a lambda's variable is evaluated once, an expression within a lambda for each element
    once = F.array(F.struct(words_of(text).alias("w"), F.floor(h / 10).alias("g")))
    return F.when(h % 10 == 0, F.transform(once, repeated)[0]).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """n_runs, the longest run (the first by start, then period, if several are; four nulls if there is none), runs_sha256 (of a line
    ``start,length,period`` for each run) and collapsed_sha256 of every row of ``collapse``, with its doc_id."""
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = F.get(best, F.lit(0))
    listed = docs.select("doc_id", "runs", "collapsed_sha256", top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    length = -F.col("top.l")
    return listed.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
