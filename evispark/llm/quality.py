"""Quality rules: base rules on counts, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, extended, grams, slices

#: Rows that the trees are fitted on at most; more labelled rows are thinned by hash.
FIT_ROWS = 20_000

SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see, and the direction in which quality may move with each (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_rate": -1,
    "dup_line_rate": -1,
    "repeat_rate": -1,
    "letter_rate": 1,
    "digit_rate": 0,
    "upper_rate": 0,
    "distinct_rate": 0,
    "top_word_rate": 0,
    "line_words": 0,
    "stop_rate": 0,
    "short_rate": 0,
}


def _per_row(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` between neighbouring ``ends``."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(total[ends])


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and its features as a matrix (texts x FEATURES)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    words = Words(texts)
    count, rows, h = words.counts, words.rows(), words.hashes()
    lengths = np.asarray(pc.utf8_length(words.values), dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw, ends = raw[ends[0] : ends[-1]], ends - ends[0]
    of_byte = lambda chars: _per_row(np.isin(raw, np.frombuffer(chars, np.uint8)), ends)
    symbols, digits = of_byte(SYMBOLS), of_byte(b"0123456789")
    upper = _per_row((raw >= 65) & (raw <= 90), ends)
    letters = _per_row((raw >= 128) | (((raw | 32) >= 97) & ((raw | 32) <= 122)), ends)
    filled = _per_row(raw > 32, ends)

    # lines equal to an earlier line of the text
    lines = pc.split_pattern(texts, "\n")
    line_rows = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    values = lines.flatten()
    worded = pc.match_substring_regex(values, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = values.dictionary_encode().indices.to_numpy()[worded].astype(np.int64)
    line_rows = line_rows[worded]
    pairs = np.unique(np.stack([line_rows, codes]), axis=1) if len(codes) else np.zeros((2, 0), np.int64)
    n_lines, distinct_lines = np.bincount(line_rows, minlength=n), np.bincount(pairs[0], minlength=n)

    # words in 5-word windows that the text has twice or more
    five = grams(h, 5)
    inside = rows[: len(five)] == rows[4:] if len(five) else np.zeros(0, bool)
    place = np.flatnonzero(inside)
    order = np.lexsort((five[place], rows[place]))
    same = (np.diff(five[place][order]) == 0) & (np.diff(rows[place][order]) == 0)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 6, np.int64)
    begin = place[order[twice]]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + 5, -1)
    repeated = _per_row(np.cumsum(cover)[: len(h)] > 0, words.offsets)

    # distinct words, and how often the commonest stands
    order = np.lexsort((h, rows))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(rows[order]) != 0)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(order)))
    distinct, top = np.bincount(rows[order][first], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(top, rows[order][first], runs)

    some = np.maximum(count, 1)
    word_chars = _per_row(lengths, words.offsets)
    counts = {
        "n_words": count,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": n_lines - distinct_lines,
        "n_repeat_words": repeated,
    }
    seen = np.maximum(filled, 1)
    features = np.stack(
        [
            np.log1p(count),
            word_chars / some,
            symbols / some,
            counts["n_dup_lines"] / np.maximum(n_lines, 1),
            repeated / some,
            letters / seen,
            digits / seen,
            upper / seen,
            distinct / some,
            top / some,
            count / np.maximum(n_lines, 1),
            _per_row(lengths <= 3, words.offsets) / some,
            _per_row(lengths == 1, words.offsets) / some,
        ],
        axis=1,
    )
    return counts, features


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf's children are itself, so scoring takes ``depth`` steps for each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        total, every = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[every, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    directions: list[int],
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    least: int = 5,
    ridge: float = 1.0,
) -> Trees:
    """Boost logistic loss over binned features.

    A split on a feature with a direction is used only if its sides' values are in that order, and the values that
    their subtrees may take stay on their side of the middle, so the score as a whole is monotonic in the feature.
    Rows in any order and no rows at all give a model (without rows or with one class, a constant).
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(width)], axis=1) if n else np.zeros((0, width), int)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(value)
        feature.append(0)
        cut.append(0.0)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, s = gradient[rows], weight[rows]
        here = float(np.clip(g.sum() / (s.sum() + ridge), low, high))
        node = leaf(rate * here)
        total[rows] = before[rows] + rate * here
        if level == depth or len(rows) < 2 * least:
            return node
        best = (1e-6, None, 0, 0.0, 0.0)
        for f in range(width):
            if not len(cuts[f]):
                continue
            b = binned[rows, f]
            size = len(cuts[f]) + 1
            gs, ss, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, s, np.ones(len(rows))))
            lv, rv = np.clip(gs / (ss + ridge), low, high), np.clip((g.sum() - gs) / (s.sum() - ss + ridge), low, high)
            gain = (2 * gs * lv - (ss + ridge) * lv**2) + (2 * (g.sum() - gs) * rv - (s.sum() - ss + ridge) * rv**2)
            gain = gain - (2 * g.sum() * here - (s.sum() + ridge) * here**2)
            ok = (ns >= least) & (len(rows) - ns >= least) & (directions[f] * (rv - lv) >= 0)
            k = int(np.argmax(np.where(ok, gain, -np.inf)))
            if ok[k] and gain[k] > best[0]:
                best = (gain[k], f, k, float(lv[k]), float(rv[k]))
        _, f, k, lv, rv = best
        if f is None:
            return node
        middle, d = (lv + rv) / 2, directions[f]
        goes = binned[rows, f] <= k
        feature[node], cut[node] = f, float(cuts[f][k])
        left[node] = grow(rows[goes], level + 1, middle if d < 0 else low, middle if d > 0 else high)
        right[node] = grow(rows[~goes], level + 1, middle if d > 0 else low, middle if d < 0 else high)
        return node

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-total))
        gradient, weight, before = y - p, p * (1 - p), total.copy()
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    as_int = lambda v: np.array(v, dtype=np.int64)
    return Trees(as_int(feature), np.array(cut), as_int(left), as_int(right), np.array(value), as_int(roots), depth, base)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **options) -> Trees:
    """Fit the trees to labelled documents: at most about ``rows`` of them, chosen by a hash of doc_id.

    Labels without a doc_id or a quality are left out; equal labels of a doc_id count once, different ones once each.
    Of several documents under one doc_id the one whose text has the smallest hash is taken, so what reaches the driver
    is a row of statistics for each chosen label. Null and empty texts have statistics of 0; whole texts are looked at.
    Without labelled documents the model is a constant. Other columns are not read.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct()
    n = known.count()
    keep = min(1.0, rows / max(n, 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(keep * (1 << 20))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(chosen), "doc_id")  # some ``rows`` rows of two numbers
    schema = "doc_id long, quality int, tie long, features array<double>"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                _, x = statistics(b.column("text"))
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("tie"), flat], ["doc_id", "quality", "tie", "features"])

    each = joined.select("doc_id", "quality", F.xxhash64("text").alias("tie"), "text").mapInArrow(measured, schema)
    one = each.groupBy("doc_id", "quality").agg(F.min(F.struct("tie", "features")).alias("x")).select("doc_id", "quality", "x.features")
    got = one.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, got["quality"].to_numpy(dtype=float), list(FEATURES.values()), **options)


def grade(docs: DataFrame, model: Trees, keep_at: float = 0.5) -> DataFrame:
    """``docs`` with the base counts, base_failed, quality (the trees' probability) and kept.

    A document fails the base rules with fewer than 10 words, or when over a fifth of its words stand in 5-word
    windows that it has twice. A null or empty text has no words, so it fails. Documents that pass are kept if the
    trees give ``keep_at`` or more. Columns of ``docs`` named like the result's are replaced; rows are graded alone,
    so copies and repeated rows get equal grades and nothing is shuffled. A text is looked at as a whole by one task,
    however long it is. An empty table gives no rows.
    """
    added = [*COUNTS, "base_failed", "quality", "kept"]
    docs = docs.drop(*added)
    out = extended(docs.schema, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees * 2^depth nodes

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                counts, x = statistics(b.column("text"))
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                good = trees.score(x)
                new = [*(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(good), pa.array(~failed & (good >= keep_at))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *added])

    return docs.mapInArrow(graded, out)
