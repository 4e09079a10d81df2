"""What the operators of this subpackage share: word rules, Arrow slices, hashes."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import dealt
from ..scratch import scratch as written  # noqa: F401

#: White space between words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of the column of texts or of lists of numbers, one row at least."""
    if not batch.num_rows:
        return
    held = batch.column(column)
    lengths = pc.list_value_length(held) if pa.types.is_list(held.type) else pc.binary_length(held)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False) * (held.type.value_type.bit_width // 8 if pa.types.is_list(held.type) else 1)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.take(pa.array(np.arange(a, b)))  # a copy: kernels that overlook an offset meet none
    pa.default_memory_pool().release_unused()  # workers live on through the stages of a job


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Words:
    """Words of a column of texts: ``values`` in order, ``offsets`` of each text's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.lower = lower
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        values, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        full = pc.not_equal(values, "")
        keep = np.asarray(full.to_numpy(zero_copy_only=False), dtype=bool)
        self.offsets = np.concatenate([[0], np.cumsum(keep)])[ends] if len(keep) else np.zeros(len(ends), np.int64)
        self.values = values.filter(full)

    def __len__(self) -> int:
        return len(self.values)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, of its form with a-z for A-Z if ``lower``; alike in every process."""
        coded = self.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        if self.lower:
            names = np.array([w.translate(_LOWER) for w in names], dtype=object)
        if not len(names):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy()]

    def joined(self, values: pa.Array, counts: np.ndarray) -> pa.Array:
        """Texts of ``counts`` words each from ``values``, with one space between words."""
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), values)
        return pc.binary_join(lists, pa.scalar(" ", values.type))

    def rows(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of a multiply-shift hash)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (positions too near the end are left out)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size, out = len(hashes) - n + 1, np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3F) + hashes[i : i + size]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    out, span = x, 1
    while 2 * span <= width:
        out, span = np.minimum(out[: len(out) - span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def extended(schema: T.StructType, added: str) -> T.StructType:
    """A new schema with the columns of ``added`` after those of ``schema``."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(added).fields])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: Copies of one row that are made in one place; more are dealt to several tasks first.
COPIES = 1000


def spread(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as its column ``times`` says, with the copy's number from 0 instead of it.

    Rows with many copies are dealt by blocks of copies before these are made, so no task makes them all.
    """
    columns = [c for c in rows.columns if c != times]
    n, block = F.col(times).cast("long"), F.lit(COPIES).cast("long")
    few = rows.filter(n.between(1, COPIES)).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(number))
    blocks = rows.filter(n > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias(number))
    begin, end = F.col(number) * block, F.least(n, (F.col(number) + 1) * block) - 1
    many = blocks.repartition(*columns, number).select(*columns, F.explode(F.sequence(begin, end)).alias(number))
    return few.unionAll(many)
