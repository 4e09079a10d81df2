"""Where word windows stand first: the part that substring dedup and suffix-array dedup share.

An *occurrence* is a stretch of a document that holds several consecutive windows and travels as one packed string:
(key, doc_id, row, start, n, lead, times, packed). ``key`` is equal wherever a window is equal, ``row`` tells apart texts
of one doc_id, ``start`` is the first window's word number, ``n`` the number of windows, ``packed`` their n + size - 1
words joined by one space, ``lead`` how many of them stand before the one that the key was taken at, and ``times`` how
many occurrences the key has.

Buckets are given a function ``groups(t, size, alone)``: (source row, number of the window in its row, group) of windows of
the rows of ``t``, whole buckets; windows are equal where their groups are. Windows that are equal to no other may be left
out unless ``alone``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, signed, slices, written

#: Occurrences that one bucket holds at most. Those of a key with more are combined to different strings first, which
#: are sorted in a bucket likewise; only a key with more different strings is dealt by window.
BUCKET = 1000
#: Windows of one occurrence at most.
RUN = 256

#: What find() says of a stretch of windows: to be removed, or the first of several.
REMOVED, FIRST = 0, 1

_FOUND = "doc_id long, row long, start int, n int, kind int"
_PLACE = "struct<doc_id: long, start: int>"
_KNOWN = f"name string, known array<struct<i: int, lead: {_PLACE}>>"


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def window_strings(packed: str, size: int, n: int) -> list[str]:
    """The n windows of ``size`` words in a packed string."""
    gaps = [-1]
    for _ in range(n + size - 2):
        gaps.append(packed.index(" ", gaps[-1] + 1))
    gaps.append(len(packed))
    return [packed[gaps[i] + 1 : gaps[i + size]] for i in range(n)]


def cut(places: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Occurrences with their packed strings, from places (key, doc_id, row, start, n, lead, times) and documents' texts."""
    wanted = places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("key", "start", "n", "lead", "times")).alias("places"))
    # a left join, as the removal at the end uses: both read one shuffle of the texts
    joined = docs.join(wanted, ["doc_id", "row"], "left").select("doc_id", "row", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole.filter(whole.column("places").is_valid()), "text"):
                words, places = Words(b.column("text")), b.column("places")
                which = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(places.offsets)))
                flat = places.flatten()
                first = words.offsets[which] + flat.field("start").to_numpy()
                counts = flat.field("n").to_numpy().astype(np.int64) + size - 1
                at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                packed = words.joined(words.values.take(pa.array(at)), counts).cast(pa.string())
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("key"), b.column("doc_id").take(take), b.column("row").take(take), *(flat.field(c) for c in ("start", "n", "lead", "times")), packed],
                    ["key", "doc_id", "row", "start", "n", "lead", "times", "packed"],
                )

    return joined.mapInArrow(run, "key long, doc_id long, row long, start int, n int, lead int, times long, packed string")


def stretches(doc, row, start, kind) -> pa.RecordBatch:
    """Consecutive windows of one kind in one document as one row."""
    doc, row, start, kind = (np.asarray(x, dtype=np.int64) for x in (doc, row, start, kind))
    order = np.lexsort((start, kind, row, doc))
    doc, row, start, kind = doc[order], row[order], start[order], kind[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(row) != 0) | (np.diff(kind) != 0) | (np.diff(start) > 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at]), pa.array(row[at]), pa.array(start[at], pa.int32()), pa.array(start[last] - start[at] + 1, pa.int32()), pa.array(kind[at], pa.int32())]
        if len(at)
        else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())],
        ["doc_id", "row", "start", "n", "kind"],
    )


def sorted_windows(t: pa.Table, size: int, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of whole buckets, sorted, so that equal ones stand together."""
    strings: list[str] = []
    counts = t.column("n").to_numpy().astype(np.int64)
    for p, n in zip(t.column("packed").to_pylist(), counts.tolist(), strict=True):
        strings += window_strings(p, size, n)
    source = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = [strings[a] != strings[b] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    return source[order], place[order], np.cumsum(new) - 1


Groups = Callable[[pa.Table, int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _edges(group: np.ndarray, doc: np.ndarray, at: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest (or ``last``: largest) (doc, at) of its group; groups count from 0 without gaps."""
    order = np.lexsort((at, doc, group))
    ends = np.flatnonzero(np.diff(group[order], append=-1)) if last else np.flatnonzero(np.diff(group[order], prepend=-1))
    pick = order[ends]
    return doc[pick][group], at[pick][group]


def _gapless(group: np.ndarray) -> np.ndarray:
    return np.unique(group, return_inverse=True)[1] if len(group) else group


def found_in(t: pa.Table, size: int, groups: Groups, within: bool) -> pa.RecordBatch:
    """What find() says of the occurrences of whole buckets."""
    source, place, group = groups(t, size, False)
    doc, row, start = (t.column(c).to_numpy().astype(np.int64)[source] for c in ("doc_id", "row", "start"))
    at, group = start + place, _gapless(group)
    lead_doc, lead_at = _edges(group, doc, at, last=False)
    last_doc, last_at = _edges(group, doc, at, last=True)
    removed = (doc > lead_doc) | (within & (doc == lead_doc) & (at > lead_at))
    keep = removed | (within & ((last_doc > lead_doc) | (last_at > lead_at)))
    return stretches(doc[keep], row[keep], at[keep], np.where(removed, REMOVED, FIRST)[keep])


def known_of(t: pa.Table, size: int, groups: Groups) -> pa.RecordBatch:
    """The first place of every window of different strings (name, first, last), where it has several; whole buckets."""
    source, place, group = groups(t, size, True)
    group = _gapless(group)
    ends = {c: [f.to_numpy().astype(np.int64)[source] for f in t.column(c).combine_chunks().flatten()] for c in ("first", "last")}
    lead_doc, lead_at = _edges(group, ends["first"][0], ends["first"][1] + place, last=False)
    last_doc, last_at = _edges(group, ends["last"][0], ends["last"][1] + place, last=True)
    keep = np.flatnonzero((last_doc > lead_doc) | (last_at > lead_at))
    keep = keep[np.lexsort((place[keep], source[keep]))]
    mine, sizes = np.unique(source[keep], return_counts=True)
    lead = pa.StructArray.from_arrays([pa.array(lead_doc[keep]), pa.array(lead_at[keep], pa.int32())], names=["doc_id", "start"])
    known = pa.StructArray.from_arrays([pa.array(place[keep], pa.int32()), lead], names=["i", "lead"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), known)
    return pa.RecordBatch.from_arrays([t.column("name").combine_chunks().take(pa.array(mine)), lists], ["name", "known"])


def _in_buckets(rows: DataFrame, schema: str, bucket: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Rows of keys that have few: each key's are in one task, whose sort is over whole keys a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for b in slices(whole, "packed", 1 << 20):
                held.append(b)
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if last:
                    yield bucket(t.slice(0, last).combine_chunks())
                    held = t.slice(last).to_batches()
        if held:
            yield bucket(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _by_window(strings: DataFrame, size: int, most: int) -> DataFrame:
    """(name, known) of strings (name, packed, times, first, last) by a 128-bit name of each window.

    What is known of a window goes back to its strings by a join. A window may stand in very many of them, so each is
    dealt to one of times / ``most`` parts by its string's name, and the window's row goes to the parts where it is.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "packed", 1 << 20):
                out: dict[str, list] = {"name": [], "i": [], "window": [], "part": [], "first": [], "last": []}
                for name, packed, times, first, last in zip(*(b.column(c).to_pylist() for c in ("name", "packed", "times", "first", "last")), strict=True):
                    n = packed.count(" ") + 2 - size
                    for i, w in enumerate(window_strings(packed, size, n)):
                        out["window"].append(hashlib.blake2b(w.encode(), digest_size=16).digest())
                        out["i"].append(i)
                        out["first"].append({"doc_id": first["doc_id"], "start": first["start"] + i})
                        out["last"].append({"doc_id": last["doc_id"], "start": last["start"] + i})
                    out["name"] += [name] * n
                    out["part"] += [int(name[:8], 16) % (times // most + 1)] * n
                kind = pa.struct([("doc_id", pa.int64()), ("start", pa.int32())])
                types = {"name": pa.string(), "i": pa.int32(), "window": pa.binary(), "part": pa.int32(), "first": kind, "last": kind}
                yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], list(out))

    each = strings.mapInArrow(windows, f"name string, i int, window binary, part int, first {_PLACE}, last {_PLACE}")
    parts = each.groupBy("window", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # a place may come in several strings, so places are compared, not counted
    best = parts.groupBy("window").agg(F.min("first").alias("lead"), F.max("last").alias("last")).filter("lead < last").select("window", "lead")
    dealt = parts.select("window", "part").join(best, "window")
    known = each.select("name", "i", "window", "part").join(dealt, ["window", "part"]).groupBy("name")
    return known.agg(F.collect_list(F.struct("i", "lead")).alias("known"))  # as many as a string has windows: RUN at most


def _frequent(rows: DataFrame, size: int, within: bool, groups: Groups, most: int) -> DataFrame:
    """Keys with many occurrences. Equal strings meet first; the different strings of a key are sorted in its bucket if
    they are few, else dealt by window; what is known of a string goes back to its occurrences.

    Nothing here gathers a key: strings and windows are combined before they are shuffled. An occurrence is dealt to
    one of times / ``most`` parts, and its string's row goes to the parts where it is, so no string gathers them either.
    """
    part = F.pmod(F.xxhash64("doc_id", "row", "start"), F.floor(F.col("times") / F.lit(most)) + 1).cast("int")
    name = F.md5(F.concat_ws(" ", "key", "lead", "packed"))
    named = written(rows.withColumns({"name": name, "part": part}), "frequent")
    place = F.struct("doc_id", "start")
    strings = named.groupBy("key", "name", "lead", "n", "times", "packed").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    strings = written(strings, "strings")
    few = written(strings.groupBy("key").agg(F.count("*").alias("different")).filter(F.col("different") <= most).select("key"), "few-strings")
    known = _in_buckets(strings.join(few, "key", "left_semi"), _KNOWN, lambda t: known_of(t, size, groups))
    known = known.unionByName(_by_window(strings.join(few, "key", "left_anti"), size, most))
    dealt = named.select("name", "part").distinct().join(known, "name")

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row, start = (b.column(c).to_numpy() for c in ("doc_id", "row", "start"))
            known = b.column("known")
            which = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(known.offsets)))
            flat = known.flatten()
            lead = flat.field("lead")
            at, lead_doc, lead_start = start[which] + flat.field("i").to_numpy(), lead.field("doc_id").to_numpy(), lead.field("start").to_numpy()
            later = (doc[which] > lead_doc) | (within & (doc[which] == lead_doc) & (at > lead_start))
            keep = later | within
            yield stretches(doc[which][keep], row[which][keep], at[keep], np.where(later, REMOVED, FIRST)[keep])

    # windows of an occurrence that follow one another become one row again
    back = named.select("name", "part", "doc_id", "row", "start").join(dealt, ["name", "part"])
    return back.select("doc_id", "row", "start", "known").mapInArrow(flagged, _FOUND)


def find(places: DataFrame, shared: DataFrame, docs: DataFrame, size: int, within: bool, groups: Groups, most: int = BUCKET) -> DataFrame:
    """(doc_id, row, start, n, kind) of windows that stand elsewhere.

    ``places`` has all stretches, ``shared`` (key, times) the keys worth a look and how often they stand; ``groups``
    finds equal windows in whole buckets, of ``most`` rows at most.

    REMOVED: the same window stands in a smaller doc_id or, if ``within``, at an earlier place (doc_id, start).
    FIRST (only if ``within``): the window's first place, and there are others.
    """
    rare = F.col("times") <= most
    cold, hot = (cut(places.join(shared.filter(which), "key"), docs, size) for which in (rare, ~rare))
    return _in_buckets(cold, _FOUND, lambda t: found_in(t, size, groups, within)).unionByName(_frequent(hot, size, within, groups, most))


def with_stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with the stretches found in it, or null."""
    mine = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n", "kind")).alias("stretches"))
    return docs.join(mine, ["doc_id", "row"], "left").select(*docs.columns, "stretches")


def place_frame(docs: DataFrame, cutter: Callable[[Words], tuple[np.ndarray, ...]]) -> DataFrame:
    """(key, doc_id, row, start, n, lead) of whatever ``cutter`` finds in the texts' words; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                row, key, start, n, lead = cutter(Words(b.column("text")))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), b.column("doc_id").take(take), b.column("row").take(take), *(pa.array(x, pa.int32()) for x in (start, n, lead))],
                    ["key", "doc_id", "row", "start", "n", "lead"],
                )

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "row", "text").mapInArrow(run, "key long, doc_id long, row long, start int, n int, lead int")


class Removal:
    """What stretches take from the texts of a batch (text, stretches): ``gone`` and ``seen`` say of each word whether
    a removed window, or any window of the stretches, covers it."""

    def __init__(self, b: pa.RecordBatch, size: int):
        self.words = words = Words(b.column("text"))
        lists = b.column("stretches").combine_chunks() if isinstance(b.column("stretches"), pa.ChunkedArray) else b.column("stretches")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        doc, flat = np.repeat(np.arange(len(lists)), lengths), lists.flatten()
        start, n, kind = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "kind"))
        begin = words.offsets[doc] + start
        end = begin + n + size - 1
        self.seen = self._cover(begin, end)
        self.gone = self._cover(begin[kind == REMOVED], end[kind == REMOVED])
        self.n_words = words.counts
        self.n_seen, self.n_gone = (np.diff(np.concatenate([[0], np.cumsum(m)])[words.offsets]) for m in (self.seen, self.gone))

    def _cover(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, begin, 1)
        np.add.at(marks, end, -1)
        return np.cumsum(marks[:-1]) > 0

    def kept(self) -> pa.Array:
        """What is left of each text, its words joined by one space."""
        return self.words.joined(self.words.values.filter(pa.array(~self.gone)), self.n_words - self.n_gone)

    def digests(self, kept: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in kept.cast(pa.large_binary()).to_pylist()], pa.string())

    def texts(self, kept: pa.Array, texts: pa.Array) -> pa.Array:
        """The texts themselves where nothing goes, else what is left."""
        return pc.if_else(pa.array(self.n_gone > 0), kept.cast(texts.type), texts)

    def spans(self) -> pa.Array:
        """[start, end) word numbers of what goes from each text."""
        rows, first = self.words.rows(), np.zeros(len(self.words), bool)
        first[self.words.offsets[:-1][self.n_words > 0]] = True
        opens = self.gone & (first | ~np.concatenate([[False], self.gone[:-1]]))
        last = np.concatenate([first[1:], [True]])[: len(first)]
        closes = self.gone & (last | ~np.concatenate([self.gone[1:], [False]]))
        at, to = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        base = self.words.offsets[rows[at]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=len(self.n_words)))])
        pair = pa.StructArray.from_arrays([pa.array(at - base, pa.int32()), pa.array(to - base, pa.int32())], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)


def without_stretches(b: pa.RecordBatch) -> list[pa.Array]:
    return [b.column(i) for i, c in enumerate(b.schema.names) if c != "stretches"]
