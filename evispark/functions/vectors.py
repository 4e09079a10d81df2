"""Hashed embeddings, encoders as plug-ins, and exact nearest neighbours by matrix product."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
#: Tokens whose bucket a worker remembers.
REMEMBERED = 1_000_000
#: Texts, and bytes of them, that a worker has in hand at once besides its batch.
TEXTS, BYTES = 1 << 11, 1 << 20
#: Bytes of tokens stay, all others part them.
_PARTED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def slices(sizes: np.ndarray, rows: int = TEXTS, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of at most ``rows`` items and about ``size`` in all; a larger item is one of its own."""
    upto, begin = np.cumsum(sizes), 0
    while begin < len(upto):
        before = upto[begin - 1] if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(upto, before + size, "right"))))
        yield begin, end
        begin = end


@dataclass(frozen=True)
class Counted:
    """How often each of some texts has each of its terms: entries in order of texts, numbers into ``terms``."""

    texts: int
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    terms: pa.Array

    def lists(self) -> pa.ListArray:
        """(term, tf) of each text."""
        kind = [pa.field("term", pa.string()), pa.field("tf", pa.int64())]
        flat = pa.StructArray.from_arrays([self.terms.take(pa.array(self.term)).cast(pa.string()), pa.array(self.tf, pa.int64())], fields=kind)
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=self.texts))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    def lengths(self) -> np.ndarray:
        """Tokens of each text."""
        return np.bincount(self.row, weights=self.tf, minlength=self.texts).astype(np.int64)

    def vectors(self, dim: int = DIM, buckets: dict[str, int] | None = None) -> np.ndarray:
        """(texts x dim) float32: 1 + ln(occurrences) in each token's bucket (md5 modulo dim), each row of length 1 or 0."""
        at = _bucket_of(self.terms, dim, {} if buckets is None else buckets)[self.term]
        out = np.bincount(self.row * dim + at, weights=self.tf, minlength=self.texts * dim).astype(float).reshape(self.texts, dim)
        full = out > 0
        out[full] = 1 + np.log(out[full])
        return _unit(out).astype(np.float32)


def counted_terms(texts: list[str | None]) -> Counted:
    """The tokens of texts, as text.tokenize gives them, counted."""
    lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])
    held = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(b"".join(lowered).translate(_PARTED)))
    parts = pc.ascii_split_whitespace(held)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    coded = parts.flatten().dictionary_encode()
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # what stands before the first token and after the last is empty
    width, code = max(1, len(full)), coded.indices.to_numpy()
    some = full[code]
    cell, tf = np.unique(row[some] * width + code[some], return_counts=True)
    return Counted(len(texts), cell // width, cell % width, tf, coded.dictionary)


def hash_vectors(texts: list[str | None], dim: int = DIM, buckets: dict[str, int] | None = None) -> np.ndarray:
    """The vectors of texts, see Counted.vectors."""
    return counted_terms(texts).vectors(dim, buckets)


def _bucket_of(terms: pa.Array, dim: int, buckets: dict[str, int]) -> np.ndarray:
    """Each term's bucket; ``buckets`` are those that are known, and get the new ones while there are fewer than REMEMBERED."""
    names = terms.to_numpy(zero_copy_only=False).tolist()
    new = [t for t in names if t not in buckets]
    digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in new), np.uint8).reshape(-1, 16)
    at = np.zeros(len(new), np.int64)
    for byte in digests.T:
        at = (at * 256 + byte) % dim
    found = dict(zip(new, at.tolist()))
    if len(buckets) + len(new) <= REMEMBERED:
        buckets.update(found)
        return np.array([buckets[t] for t in names], np.int64)
    return np.array([found[t] if t in found else buckets[t] for t in names], np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def hash_embed(c: Column, dim: int = DIM) -> Column:
    """array<float>: the hashed embedding of a text; the zero vector for null and texts without tokens."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets: dict[str, int] = {}
        for texts in batches:
            out, sizes = np.empty((len(texts), dim), np.float32), pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for i, j in slices(sizes):
                out[i:j] = hash_vectors(texts.slice(i, j - i).to_pylist(), dim, buckets)
            yield vector_lists(out)

    return embed(c)


def vector_lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), pa.array(matrix.reshape(-1)))


def encode_with(load: Callable[[], Callable[[list[str]], np.ndarray]], c: Column) -> Column:
    """array<float> from an encoder that each Python worker loads once; it maps texts to a matrix."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            matrix = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(matrix), index=texts.index, dtype=object)

    return embed(c)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in -1..1; 0 where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))
