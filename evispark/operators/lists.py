"""Dense search by inverted lists: vectors by their nearest centroid, with lists skipped that a bound proves to hold no hit.

Between vectors of length 1 angles keep the triangle inequality, so nothing in a list is nearer to a question than the angle
between question and centroid, less the list's radius. Results are those of retrieval.dense_topk, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import parsed
from .retrieval import QUESTION_BLOCK, _Best, _unit, few, top_by

#: Vectors that centroids are fitted on at most, lists at most, and rounds of fitting.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 8
#: The list of vectors without length, which are as near to everything.
NOWHERE = -1
#: What angles in floating point can be off, at most.
SLACK = 1e-6
#: Vectors that a worker has in hand at once besides its batch.
SOME = 1 << 11


def rows_of(vectors: pa.Array) -> np.ndarray:
    """(vectors x width), as doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def matrix(vectors) -> np.ndarray:
    return _unit(np.array([np.asarray(v, dtype=np.float64) for v in vectors]))


def fit_centroids(vectors: DataFrame, key: str = "chunk_id", lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """(lists x width) centroids of length 1, by spherical k-means over those ``sample`` vectors whose keys have the smallest
    hashes; by default as many as the square root of the sample, LISTS at most. Only which lists can be skipped depends on them."""
    chosen = vectors.filter(F.size("vector") > 0).orderBy(F.xxhash64(key), key).limit(sample).select("vector").collect()  # SAMPLE rows
    x = matrix(r["vector"] for r in chosen)
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((0, 0))
    n = min(lists or LISTS, max(1, int(np.sqrt(len(x)))), len(x))
    centroids = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        moved = _unit(sums)
        centroids = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centroids)
    return centroids


@dataclass
class ListIndex:
    """``rows`` (key, vector) in a folder for each list, and ``lists`` (list, centroid, radius, n)."""

    rows: DataFrame
    lists: DataFrame
    key: str = "chunk_id"

    @classmethod
    def write(cls, vectors: DataFrame, path: str, key: str = "chunk_id", lists: int | None = None) -> ListIndex:
        """Put every vector into the list of its nearest centroid; a large list is several files."""
        spark = vectors.sparkSession
        shared = spark.sparkContext.broadcast(fit_centroids(vectors, key, lists))  # LISTS vectors
        kind = dict(vectors.select(key).dtypes)[key]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                for i in range(0, b.num_rows, SOME):
                    some = b.slice(i, SOME)
                    x = _unit(rows_of(some.column("vector")))
                    near = x @ c.T if len(c) else np.zeros((len(x), 1))
                    at, empty = near.argmax(axis=1), np.abs(x).sum(axis=1) == 0
                    angle = np.arccos(np.clip(near[np.arange(len(x)), at], -1, 1))
                    found = [pa.array(np.where(empty, 0.0, angle)), pa.array(np.where(empty, NOWHERE, at).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*some.columns, *found], [key, "vector", "angle", "list"])

        wide = vectors.select(key, F.col("vector").cast("array<double>")).filter(F.size("vector") > 0)
        placed = wide.mapInArrow(place, f"{key} {kind}, vector array<double>, angle double, list int")
        placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
        rows = spark.read.schema(f"{key} {kind}, vector array<double>, angle double, list int").parquet(f"{path}/rows")
        centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(shared.value)], "list int, centroid array<double>")
        counted = rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        counted.join(centroids, "list", "left").write.parquet(f"{path}/lists")
        return cls.open(spark, path, key)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str = "chunk_id") -> ListIndex:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists"), key)


class Bounds:
    """What each list can have at most for each of some questions: (questions x lists) cosines."""

    def __init__(self, index: ListIndex, questions: np.ndarray):
        held = index.lists.orderBy("list").collect()  # LISTS rows and one
        self.names, self.sizes = np.array([r["list"] for r in held], np.int64), np.array([r["n"] for r in held], np.int64)
        self.most = np.zeros((len(questions), len(held)))
        real = np.abs(questions).sum(axis=1) > 0
        for j, r in enumerate(held):
            if r["list"] != NOWHERE:
                angle = np.arccos(np.clip(questions @ np.array(r["centroid"]), -1, 1))
                self.most[:, j] = np.where(real, np.cos(np.maximum(angle - r["radius"] - SLACK, 0)), 0.0)

    def nearest(self, k: int) -> np.ndarray:
        """Lists that promise most to each question, as many as hold k vectors."""
        order = np.argsort(-self.most, axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(self.most.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out

    def reaching(self, floor: np.ndarray, digits: int | None) -> np.ndarray:
        """Lists that can have what reaches each question's floor, ties included."""
        most = self.most + SLACK if digits is None else np.round(self.most + SLACK, digits)
        return most >= floor[:, None]


def _scan(index: ListIndex, ids: list, questions: np.ndarray, bounds: Bounds, wanted: np.ndarray, k: int, digits: int | None, kind: str) -> DataFrame:
    """The k best of each question in the lists that are wanted for it; other lists' files are not read."""
    key = index.key
    asking = {int(name): np.flatnonzero(wanted[:, j]) for j, name in enumerate(bounds.names) if wanted[:, j].any()}
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, questions, asking))  # QUESTION_BLOCK vectors

    out = to_arrow_schema(parsed(kind))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, asking = shared.value
        best = _Best(k, len(ids))
        for b in (batch.slice(i, SOME) for batch in batches for i in range(0, batch.num_rows, SOME)):
            x, names, keys = _unit(rows_of(b.column("vector"))), b.column("list").to_numpy(), np.array(b.column(key).to_pylist())
            for name in np.unique(names):
                who, mine = asking[int(name)], names == name
                scores = x[mine] @ q[who].T
                best.add(keys[mine], scores if digits is None else np.round(scores, digits), questions=who)
        if best.parts:
            yield from pa.Table.from_pandas(best.frame(ids, key, "dense_score"), schema=out, preserve_index=False).to_batches()

    return index.rows.filter(F.col("list").isin(list(asking))).select(key, "vector", "list").mapInArrow(best_of, kind)


def list_topk(queries: DataFrame, index: ListIndex, k: int = 25, digits: int | None = None, block: int = QUESTION_BLOCK) -> DataFrame:
    """(query_id, key, dense_score, dense_rank) as retrieval.dense_topk gives them, from as few lists as bounds allow.

    The lists that promise most give each question k hits and so a floor; then those are read whose bound reaches it. More than
    ``block`` questions are answered a block at a time, each by jobs over the lists that it needs.
    """
    spark, key = queries.sparkSession, index.key
    kind = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(index.rows.dtypes)[key]}, dense_score double"
    asked = queries.select("query_id", "vector").filter(F.size("vector") > 0)
    blocks = 1 if few(asked.select("query_id"), block) is not None else -(-asked.count() * 2 // block)
    found = []
    for n in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()  # about half of ``block``
        if not rows:
            continue
        ids, q = [r["query_id"] for r in rows], matrix(r["vector"] for r in rows)
        bounds = Bounds(index, q)
        first = bounds.nearest(k)
        near = top_by(_scan(index, ids, q, bounds, first, k, digits, kind), k, F.desc("dense_score"), F.asc(key)).drop("rank")
        reached = {r["query_id"]: r["floor"] for r in near.groupBy("query_id").agg(F.min("dense_score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k).collect()}
        floor = np.array([reached.get(i, -np.inf) for i in ids])
        found += [near, _scan(index, ids, q, bounds, bounds.reaching(floor, digits) & ~first, k, digits, kind)]
    every = spark.createDataFrame([], kind)
    for part in found:
        every = every.unionByName(part)
    return top_by(every, k, F.desc("dense_score"), F.asc(key), name="dense_rank")
