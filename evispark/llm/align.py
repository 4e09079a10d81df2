"""Alignment of two tokenizers: the ends of their tokens as events, swept in order of offset within each document.

Both sides' end events travel in runs: (row, doc_id, offset, side, ids), the ids of one side's tokens that end in a window of bytes
up to ``offset``; the bytes that a token covers follow from its id. Runs are dealt by document and sorted by offset and side; a
pass over them cuts the tokens into groups wherever both sides end, and links every A with every B token of a group.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import slices, written
from .pieces import BYTE, ENCODED_BYTES, NORMAL, SPACE_MARK, PieceModel, few, one_thread

#: Sides of an event.
A, B = 0, 1
#: Bytes of text that one run of events covers.
WINDOW = 1 << 16
#: Segments that a worker remembers the tokens of; beyond that it keeps half as many, which most slices had.
REMEMBERED = 1 << 17
#: Segments that are encoded in one string.
TOGETHER = 64
#: Links of one group that are written out one by one; larger groups are counted by distinct ids.
SPREAD = 1 << 14
#: Different pairs that a task counts before it hands them on.
COUNTED = 1 << 20
#: Bytes of ids or of pairs that a task sweeps, counts or scores at once: as links, in 64 bits and as text they take many times that.
SWEPT_BYTES = 1 << 18
#: Pairs whose counts are broadcast at most.
HOT_PAIRS = 1 << 20

_NOTHING, _SPACE, _COMMA, _BAR, _SEMICOLON = (pa.scalar(c, pa.large_string()) for c in ("", " ", ",", "|", ";"))
_NO_BYTES = pa.scalar(b"", pa.large_binary())
_EVENT = "row long, doc_id long, offset long, side int, ids binary"
_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


class ByteModel:
    """A byte-level BPE model file of the tokenizers library; picklable by its text."""

    def __init__(self, raw: str):
        self.raw = raw
        held = json.loads(raw)
        before = held["pre_tokenizer"] or {}
        if held["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only plain byte-level models are aligned")

    def __reduce__(self):
        return ByteModel, (self.raw,)

    @classmethod
    def load(cls, path: str) -> ByteModel:
        """Read a model file on the driver; tasks get its text."""
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    @cached_property
    def tokenizer(self) -> Tokenizer:
        out = Tokenizer.from_str(self.raw)
        out.no_truncation()
        out.no_padding()
        out.encode_special_tokens = True  # their strings in a text are plain text
        return out

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """What each id stands for. Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on."""
        plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names]

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def piece_bytes(model: PieceModel) -> list[bytes]:
    """What each id of a SentencePiece model stands for; nothing where it is no text."""
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE_MARK, " ").encode() if kind == NORMAL else b"" for p, _, kind in model.pieces]


def _clear(words: pa.Array) -> np.ndarray:
    """Whether each word ends in something that is white space in nobody's eyes."""
    last = pc.binary_slice(words.cast(pa.large_binary()), -1)
    out = np.array(pc.and_(pc.greater(last, b" "), pc.less(last, b"\x7f")))
    other = np.flatnonzero(np.array(pc.greater(last, b"\x7f")))
    out[other] = ~np.array(pc.match_substring_regex(words.take(pa.array(other)), r"[\x{80}-\x{A0}\p{Z}]$"))
    return out


def segments_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of space + text that no token crosses, and where each text's begin.

    Cuts are before a space or newline that follows anything but white space: neither model has a token with these after
    another character. A text with a NUL, which marks the cuts here, is one part.
    """
    spaced = pc.binary_join_element_wise(_SPACE, texts, _NOTHING)
    marked = pc.replace_substring(pc.replace_substring(spaced, " ", "\x00 "), "\n", "\x00\n")
    odd = pc.match_substring(texts, "\x00")
    lists = pc.split_pattern(pc.if_else(odd, "", marked), "\x00")
    words, ends = lists.flatten(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    new = np.ones(len(words), bool)
    new[1:] = _clear(words)[:-1]
    new[ends[:-1]] = True  # every text has a word, if only an empty one
    starts = np.append(np.flatnonzero(new), len(words))
    parts, begin = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts), words), _NOTHING), np.searchsorted(starts, ends)
    if pc.any(odd).as_py():
        at = np.flatnonzero(np.array(odd))
        where = np.full(len(parts), -1)
        where[begin[at]] = np.arange(len(at))
        parts = pc.if_else(pa.array(where >= 0), spaced.take(pa.array(at[np.maximum(where, 0)])), parts)
    return parts, begin


class Tokens:
    """Ids of both models for texts, by their distinct segments, of which REMEMBERED or so are kept."""

    def __init__(self, a: ByteModel, b: PieceModel):
        if not b.cuts or not b.byte_fallback or any("\n" in p for p, _, _ in b.pieces):
            raise ValueError("only models with byte fallback and without pieces across spaces or newlines are aligned")
        self.a, self.b = a, b
        self.bytes = [pa.array(t, pa.large_binary()) for t in (a.token_bytes, piece_bytes(b))]
        self.covers = [pc.binary_length(t).to_numpy() for t in self.bytes]
        #: remembered segments, in how many slices each was, whether its ids spell it, and where these are in ``bank``
        self.known, self.slices, self.whole = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool)
        self.begin, self.length, self.bank = ([np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.uint16)] * 2)

    def _forget(self) -> None:
        """Keep the half that most slices had, of equals the later ones; what slices long ago had counts for less and less."""
        keep = np.sort(np.argsort(self.slices, kind="stable")[-(REMEMBERED // 2) :])
        self.known, self.slices, self.whole = self.known.take(pa.array(keep)), self.slices[keep] // 2, self.whole[keep]
        for side in (A, B):
            self.bank[side], sums = self._ids(side, keep)
            self.begin[side], self.length[side] = sums[:-1], self.length[side][keep]

    def _ids(self, side: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these segments one after another, and where each segment's begin."""
        length = self.length[side][at]
        sums = np.concatenate([[0], np.cumsum(length)])
        return self.bank[side][np.repeat(self.begin[side][at] - sums[:-1], length) + np.arange(sums[-1])], sums

    def _encode_b(self, parts: list[str]) -> list[list[int]]:
        # the library puts the first space itself: one too many before a newline, and none before nothing
        lists = self.b.library.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [(x or [self.b.marker]) if p[0] == " " else x[1:] for p, x in zip(parts, lists, strict=True)]

    def _encode(self, side: int, segments: pa.Array, together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, how many each segment has, and whether they spell it. ``together`` segments are encoded in
        one string, as no token crosses their borders; if that is not spelt, each is encoded alone."""
        parts = segments
        if together > 1:
            ends = np.append(np.arange(0, len(segments), together), len(segments))
            parts = pc.binary_join(_lists(segments, np.diff(ends)), _NOTHING)
        encode = self.a.encode if side == A else self._encode_b
        lists = [np.array(x, np.uint16) for some in few(parts.to_numpy(zero_copy_only=False).tolist()) for x in encode(some)]
        ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        spelt = pc.binary_join(_lists(self.bytes[side].take(pa.array(ids)), sizes), _NO_BYTES)
        whole = np.array(pc.equal(spelt, parts.cast(pa.large_binary())))
        if together == 1:
            return ids, sizes, whole
        if not whole.all():
            return self._encode(side, segments, 1)
        ends = np.searchsorted(np.cumsum(self.covers[side][ids]), np.cumsum(pc.binary_length(segments).to_numpy())) + 1
        return ids, np.diff(ends, prepend=0).astype(np.int64), np.ones(len(segments), bool)

    def _learn(self, fresh: pa.Array) -> None:
        """Segments that end in what may be white space, which others could join, and those with B's marker go alone."""
        alone, n = ~_clear(fresh) | np.array(pc.match_substring(fresh, SPACE_MARK)), len(self.whole)
        self.whole = np.concatenate([self.whole, np.ones(len(fresh), bool)])
        for side in (A, B):
            held, size = [self.bank[side]], len(self.bank[side])
            begin, length = np.zeros((2, len(fresh)), np.int64)
            for mine, together in ((~alone, TOGETHER), (alone, 1)):
                if mine.any():
                    ids, length[mine], whole = self._encode(side, fresh.filter(pa.array(mine)), together)
                    begin[mine] = size + np.cumsum(length[mine]) - length[mine]
                    self.whole[n:][mine] &= whole
                    held.append(ids)
                    size += len(ids)
            self.begin[side], self.length[side] = np.concatenate([self.begin[side], begin]), np.concatenate([self.length[side], length])
            self.bank[side] = np.concatenate(held)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Whether each text has tokens that spell it on both sides, and for each side all ids and where each text's begin."""
        if len(self.known) > REMEMBERED:
            self._forget()
        segments, ends = segments_of(texts)
        n = len(self.known)
        coded = pa.concat_arrays([self.known, segments]).dictionary_encode()  # what is known comes first, in order
        at, self.known = coded.indices.to_numpy()[n:], coded.dictionary
        self._learn(self.known.take(pa.array(np.arange(n, len(self.known)))))
        self.slices = np.concatenate([self.slices, np.zeros(len(self.known) - n, np.int64)]) + (np.bincount(at, minlength=len(self.known)) > 0)
        bad = np.concatenate([[0], np.cumsum(~self.whole[at])])
        out = []
        for side in (A, B):
            ids, sums = self._ids(side, at)
            out.append((ids, sums[ends]))
        return np.diff(bad[ends]) == 0, out


def end_events(docs: DataFrame, a: ByteModel, b: PieceModel, window: int = WINDOW) -> DataFrame:
    """Runs of end events of (row, doc_id, text), both sides in one table; a text without tokens has an empty run on each side.

    Texts are encoded as wholes by a task; what they share is encoded once for a worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast((a, b))  # the model files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        tokens = Tokens(*shared.value)
        for whole in batches:
            for part in slices(whole, "text", ENCODED_BYTES):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                fine, sides = tokens.of(texts)
                fine &= pc.binary_length(texts).to_numpy() > 0
                size = np.where(fine, pc.binary_length(texts).to_numpy() + 1, 0)
                source, offset, side, ids = [], [], [], []
                for k, (all_ids, begin) in enumerate(sides):
                    raw = all_ids.tobytes()
                    for i, (lo, hi, n) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), size.tolist(), strict=True)):
                        runs = max(1, -(-n // window))
                        cuts = [lo, hi if n else lo]
                        if runs > 1:
                            ends = np.cumsum(tokens.covers[k][all_ids[lo:hi]])
                            cuts = (lo + np.searchsorted(ends, np.arange(runs + 1) * window, "right")).tolist()
                        source += [i] * runs
                        side += [k] * runs
                        offset += [(j + 1) * window for j in range(runs)]
                        ids += [raw[2 * x : 2 * y] for x, y in zip(cuts, cuts[1:], strict=False)]
                take = pa.array(source, pa.int64())
                rest = [pa.array(offset, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("row").take(take), part.column("doc_id").take(take), *rest], ["row", "doc_id", "offset", "side", "ids"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, _EVENT)


def merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def link_pairs(ids: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc << 32 | A id << 16 | B id, times) of all links of groups, which have so many tokens from ``starts`` on and a document each."""
    (ia, ib), (sa, sb), (na, nb) = ids, starts, counts
    links = na * nb
    few = np.where(links <= SPREAD, links, 0)
    g = np.repeat(np.arange(len(links)), few)
    k = np.arange(len(g)) - np.repeat(np.cumsum(few) - few, few)
    x, y = ia[sa[g] + k // nb[g]].astype(np.int64), ib[sb[g] + k % nb[g]].astype(np.int64)
    keys, times = np.unique(doc[g] << 32 | x << 16 | y, return_counts=True)
    if (large := np.flatnonzero(links > SPREAD)).size:
        more = [(keys, times)]
        for i in large.tolist():
            (ua, ta), (ub, tb) = (np.unique(v[s[i] : s[i] + n[i]].astype(np.int64), return_counts=True) for v, s, n in ((ia, sa, na), (ib, sb, nb)))
            more.append(((doc[i] << 32 | ua[:, None] << 16 | ub[None, :]).ravel(), (ta[:, None] * tb[None, :]).ravel()))
        keys, times = merged(*(np.concatenate(x) for x in zip(*more, strict=True)))
    return keys, times


class Document:
    """What the sweep knows of the document that it is in."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id = row, doc_id
        self.sums, self.digest, self.links = np.zeros(4, np.int64), hashlib.sha256(), []

    def add(self, sums: np.ndarray, groups: str, keys: np.ndarray, times: np.ndarray) -> None:
        if groups:
            self.digest.update((";" * bool(self.sums[2]) + groups).encode())
        self.sums += sums
        self.links.append((keys & 0xFFFFFFFF, times))

    def result(self) -> tuple:
        keys, times = self.links[0] if len(self.links) == 1 else merged(*(np.concatenate(x) for x in zip(*self.links, strict=True)))
        return (self.row, self.doc_id, *self.sums.tolist(), self.digest.hexdigest() if self.sums[0] else "", keys.astype(np.uint32).view(np.int32), times.astype(np.int32))


class Sweep:
    """A pass over runs of events in order. Between runs it keeps the tokens after the last common end (``open``), and the
    sums, digest and links of the document that it is in."""

    def __init__(self, covers: list[np.ndarray]):
        self.covers = covers
        self.names = pa.array([str(i) for i in range(max(map(len, covers)))], pa.large_string())
        self.open = [np.zeros(0, np.uint16)] * 2
        self.current: Document | None = None

    def feed(self, events: pa.RecordBatch) -> list[tuple]:
        """Results of the documents that end before the last of these runs, which are A and B in turn."""
        row, doc_ids = events.column("row").to_numpy()[::2], events.column("doc_id").take(pa.array(np.arange(0, events.num_rows, 2))).to_pylist()
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        new[0] = self.current is None or row[0] != self.current.row
        first = np.flatnonzero(new)
        doc = np.cumsum(new)  # 0 is the document that goes on
        n_docs = int(doc[-1]) + 1
        ids, of, starts, counts = [], [], [], []
        for k in (A, B):
            runs = events.column("ids").take(pa.array(np.arange(k, events.num_rows, 2)))
            sizes = pc.binary_length(runs).to_numpy().astype(np.int64) // 2
            ids.append(np.concatenate([self.open[k], np.frombuffer(b"".join(runs.to_pylist()), np.uint16)]))
            of.append(np.concatenate([np.full(len(self.open[k]), doc[0]), np.repeat(doc, sizes)]))
        ends = [np.cumsum(c[i]) for c, i in zip(self.covers, ids, strict=True)]
        common = np.zeros(max([1, *(int(e[-1]) + 1 for e in ends if len(e))]), np.int8)
        for e in ends:
            common[e] += 1
        for k in (A, B):
            cut = np.flatnonzero(common[ends[k]] == 2) + 1
            starts.append(np.concatenate([[0], cut])[:-1])
            counts.append(np.diff(cut, prepend=0))
            self.open[k] = ids[k][int(cut[-1]) if len(cut) else 0 :]
            ids[k] = ids[k][: len(ids[k]) - len(self.open[k])]
        of_group = of[A][starts[A]]
        keys, times = link_pairs(tuple(ids), tuple(starts), tuple(counts), of_group)
        sums = np.stack([np.bincount(of_group, w, n_docs).astype(np.int64) for w in (counts[A], counts[B], None, counts[A] * counts[B])], axis=1)
        texts = self._texts(ids, counts, np.bincount(of_group, minlength=n_docs))
        place = np.searchsorted(keys >> 32, np.arange(n_docs + 1))
        done = []
        for d in range(n_docs):
            if d:  # the one before has ended
                if self.current is not None:
                    done.append(self.current.result())
                at = int(first[d - 1])
                self.current = Document(int(row[at]), doc_ids[at])
            if self.current is not None:
                mine = slice(int(place[d]), int(place[d + 1]))
                self.current.add(sums[d], texts[d], keys[mine], times[mine])
        return done

    def _texts(self, ids: list[np.ndarray], counts: list[np.ndarray], groups: np.ndarray) -> list[str]:
        """The groups of each document, written as a1,a2|b1;a3|b2,b3."""
        sides = [pc.binary_join(_lists(self.names.take(pa.array(i)), n), _COMMA) for i, n in zip(ids, counts, strict=True)]
        return pc.binary_join(_lists(pc.binary_join_element_wise(*sides, _BAR), groups), _SEMICOLON).to_pylist()

    def end(self) -> list[tuple]:
        return [] if self.current is None else [self.current.result()]


def _lists(values: pa.Array, counts: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), values)


def sweep(events: DataFrame, a: ByteModel, b: PieceModel) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each document, from its events.

    ``pairs`` has the different linked id pairs, A id << 16 | B id as 32 bits, ``times`` how often the document links each.
    """
    lengths = [np.array([len(x) for x in t], np.int64) for t in (a.token_bytes, piece_bytes(b))]
    shared = events.sparkSession.sparkContext.broadcast(lengths)  # workers that sweep hold no model

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        scalars = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
        ends = pa.array(np.cumsum([0, *(len(r[7]) for r in rows)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]), pa.int32())) for i in (7, 8)]
        return pa.RecordBatch.from_arrays(
            [*scalars, pa.array([r[6] for r in rows], pa.string()), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep(shared.value)
        held: pa.RecordBatch | None = None
        for whole in batches:
            for part in slices(whole, "ids", SWEPT_BYTES):
                part = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                pairs = part.num_rows // 2 * 2  # an A run waits for its B run
                held = part.slice(pairs) if pairs < part.num_rows else None
                if pairs and (done := state.feed(part.slice(0, pairs))):
                    yield batch(done)
        if done := state.end():
            yield batch(done)

    ordered = events.repartition("row").sortWithinPartitions("row", "offset", "side")
    return ordered.mapInArrow(run, _LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more. Tasks add up
    pairs before these are shuffled; an A id has no more pairs than there are B ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            return merged(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for whole in batches:
            for b in slices(whole, "pairs", SWEPT_BYTES):
                keys, n = np.unique(b.column("pairs").flatten().to_numpy(), return_counts=True)
                held.append((keys, n.astype(np.int64)))
                size += len(keys)
                if size > COUNTED:
                    held = [added()]
                    size = len(held[0][0])
                if size > COUNTED // 2 and len(held) == 1:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, added())], ["pair", "n"])

    each = linked.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftrightunsigned("pair", 16))
    return each.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def scored(linked: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``linked`` without its pairs, with n_best and count_sum: links whose pair is its A id's best, and the sum of counts.

    A pair is hot if it makes at least 1 / ``hot_pairs`` of all counts (or if there are no more pairs than that): such are
    ``hot_pairs`` at most, whatever the corpus, and are broadcast. The others join to the documents that have them by a
    shuffle in which no key is frequent.
    """
    spark = linked.sparkSession
    total, different = counts.agg(F.sum("n"), F.count("*")).first()
    least = 1 if different <= hot_pairs else math.ceil(total / hot_pairs)
    hot = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest"]
        for whole in batches:
            for b in slices(whole, "pairs", SWEPT_BYTES):
                lists = b.column("pairs")
                size = pc.list_value_length(lists).to_numpy().astype(np.int64)
                pairs, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "times"))
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                row = np.repeat(np.arange(b.num_rows), size)
                mine = times[known].astype(np.int64)
                sums = []
                for value in (best[at[known]], n[at[known]]):
                    ends = np.concatenate([[0], np.cumsum(mine * value)])
                    sums.append(np.diff(ends[np.searchsorted(row[known], np.arange(b.num_rows + 1))]))
                rest = pa.StructArray.from_arrays([pa.array(pairs[~known], pa.int32()), pa.array(times[~known], pa.int32())], names=["pair", "times"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=b.num_rows))])
                columns = [b.column(c) for c in names[:7]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(s, pa.int64()) for s in sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], names)

    schema = f"{_LINKED.split(', pairs')[0]}, n_best long, count_sum long, rest array<struct<pair: int, times: int>>"
    found = linked.mapInArrow(run, schema)
    if least == 1:  # all pairs are hot
        return found.drop("rest")
    found = written(found, "partly-scored")
    cold = counts.filter(F.col("n") < least)
    each = found.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times").join(cold, "pair")
    more = each.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    joined = found.drop("rest").join(more, "row", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))}).drop("b", "c")


def align(docs: DataFrame, a: ByteModel, b: PieceModel, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text, to which it adds that space; offsets are bytes of that. Tokens between two
    offsets where both sides end are a group, whose A and B tokens are all linked. A pair's count is the number of rows that
    link it; best are the pairs of an A id with the highest count, ties included. groups_sha256 is of the ids, as in
    ``a1,a2|b1;a3|b2``.

    A text that is null, empty or not spelt by either side's tokens (such as one with U+2581, which B reads as a space) has no
    tokens: zeros and an empty groups_sha256. Each row is a document of its own, so repeated rows and doc_ids count as often as
    they stand, and null doc_ids are carried along. Texts are aligned as a whole, however long; an empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = written(sweep(end_events(rows, a, b), a, b), "linked")
    counts = written(pair_counts(linked), "pair-counts")
    return scored(linked, counts, hot_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
