"""The chunk index: admitted chunks with vectors, and BM25 statistics beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from ..functions.vectors import DIM, Counted, counted_terms, hash_embed, slices, vector_lists
from ..schemas import parsed
from ..scratch import DENSE, scratch, swept
from ..sources.folders import create, drop, found


#: Columns of postings, of packed vectors and of what a task has seen; how many terms it holds for that.
POSTED = "doc_len int, terms array<struct<term: string, tf: long>>"
PACKED = "width int, bits binary, vals binary"
SEEN = "seen array<struct<term: string, df: long>>"
KIND, HELD = pa.struct([("term", pa.string()), ("df", pa.int64())]), 1 << 17


class DimensionMismatch(ValueError):
    """A query encoder whose width differs from the index's."""


def embed(chunks: DataFrame, encoder=None, text: str = "text") -> DataFrame:
    """With vector: the hashed embedding, or what ``encoder`` (column to column) gives."""
    return chunks.withColumn("vector", (encoder or hash_embed)(F.col(text)))


def sanitise_metadata(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null becomes an empty text, scalars stay as they are where not null, nested values become JSON.

    A column holds one type, so scalars are given as text.
    """
    out = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.coalesce(F.to_json(f.name), F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


class DuplicateChunks(ValueError):
    """Chunks whose ids stand more than once, or are in the index already."""


class ChunkStore:
    """Chunks under ``path`` in buckets by chunk_id, sorted within them, so that what is joined to them by id moves and they don't.

    Ids are compared bucket by bucket, where the chunks are, and ids that clash are an error: nothing is dropped. A reset
    writes a new generation and lets the old one go when that is there; until then, and if it fails, the old one stays.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _ready(self) -> tuple[int, int]:
        """The newest generation and its buckets; -1 if there is none."""
        names = [p.rsplit("/", 1)[1] for p in found(self.spark, f"{self.path}/ready/*")]
        return max(((int(g), int(n)) for g, n in (x.split("-") for x in names)), default=(-1, self.buckets))

    def _name(self, generation: int) -> str:
        return f"chunks_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{generation}"

    def _at(self, generation: int) -> str:
        return f"{self.path}/rows/{generation:08d}"

    def _table(self, generation: int, buckets: int, schema: T.StructType | None = None) -> DataFrame:
        """The chunks of a generation; a session that doesn't know their buckets is told."""
        name = self._name(generation)
        if not self.spark.catalog.tableExists(name):
            schema = schema or self.spark.read.parquet(self._at(generation)).schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            clustered = f"CLUSTERED BY (chunk_id) SORTED BY (chunk_id) INTO {buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {clustered} LOCATION '{self._at(generation)}'")
        return self.spark.table(name)

    def read(self) -> DataFrame:
        generation, buckets = self._ready()
        if generation < 0:
            raise FileNotFoundError(f"no chunks at {self.path}")
        return self._table(generation, buckets)

    def write(self, chunks: DataFrame, reset: bool = False, rounds: int = 1) -> DataFrame:
        """Write chunks and give those that are there then; with ``reset`` those from before go.

        A new generation can be written in ``rounds``, each with its share of the buckets, so that no more than that share of the texts
        is in shuffle files at once; ``chunks`` are read for each.
        """
        old, kept = self._ready()
        if reset or old < 0:
            generation, buckets = old + 1, self.buckets
            drop(self.spark, self._at(generation))  # what a failed reset has left
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(generation)}")
            for i in range(rounds):
                share = chunks if rounds == 1 else chunks.filter(F.pmod(F.hash("chunk_id"), F.lit(buckets)) % rounds == i)
                self._save(share, generation, buckets)
            self._refuse(self._table(generation, buckets).groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1"))
            create(self.spark, f"{self.path}/ready/{generation}-{buckets}")
            if old >= 0:
                drop(self.spark, f"{self.path}/ready/{old}-{kept}")
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(old)}")
                drop(self.spark, self._at(old))
            return self._table(generation, buckets)
        there = self._table(old, kept)
        fresh = scratch(chunks.repartition(kept, "chunk_id"), "chunks")
        self._refuse(fresh.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1"))
        self._refuse(there.select("chunk_id").join(fresh.select("chunk_id").hint("shuffle_hash"), "chunk_id", "left_semi"))
        self._save(fresh.select(*there.columns), old, kept)
        self.spark.catalog.refreshTable(self._name(old))
        return self._table(old, kept)

    def _save(self, chunks: DataFrame, generation: int, buckets: int) -> None:
        held = chunks.repartition(buckets, "chunk_id")  # a task has a bucket, so that each is one file
        writer = held.write.bucketBy(buckets, "chunk_id").sortBy("chunk_id").mode("append").options(**DENSE).option("path", self._at(generation))
        with swept(self.spark):
            writer.format("parquet").saveAsTable(self._name(generation))

    def _refuse(self, clashing: DataFrame) -> None:
        some = [r["chunk_id"] for r in clashing.select("chunk_id").limit(5).collect()]
        if some:
            raise DuplicateChunks(f"{self.path}: {some}")


def _widths(width: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("chunks"), F.min(width).alias("min_dim"), F.max(width).alias("max_dim")]


def _lengths() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len")]


def index_stats(df: DataFrame) -> DataFrame:
    """(chunks, min_dim, max_dim) over every row."""
    return df.agg(*_widths(F.size("vector")))


def check_dimensions(stats: DataFrame, dim: int) -> None:
    """Raise if vectors of an index with these ``stats`` (see index_stats) have another width than ``dim``."""
    row = stats.first()
    if row["chunks"] and (row["min_dim"], row["max_dim"]) != (dim, dim):
        raise DimensionMismatch(f"the index has vectors of {row['min_dim']} to {row['max_dim']} values, the encoder {dim}")


def encoder_width(spark: SparkSession, encoder=None) -> int:
    """How many values the vectors of an encoder have."""
    return spark.range(1).select(F.size((encoder or hash_embed)(F.lit("width"))).alias("n")).first()["n"]


def _counted(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Counted]]:
    """Some rows at a time, and the terms of their texts."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, j in slices(sizes):
            some = b.slice(i, j - i)
            yield some, counted_terms(some.column(text).to_pylist())


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, doc_len, terms): each text's length in tokens, and how often it has each of its terms, as (term, tf).

    The task that reads a text cuts it into tokens and counts these, so nothing is shuffled; it has some texts in hand at once.
    """
    schema = T.StructType([chunks.schema[key], *parsed(POSTED).fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, counted in _counted(batches, text):
            yield pa.RecordBatch.from_arrays([some.column(key), pa.array(counted.lengths(), pa.int32()), counted.lists()], schema.names)

    return chunks.select(key, text).mapInArrow(count, schema)


def entries(chunks: DataFrame, encoder=None) -> DataFrame:
    """Postings by chunk_id with vectors, from one pass over the texts: width, bits and vals are what pack() gives of a vector (one
    of another type than array<float> stays as vector). What seen has in some rows is the number of a task's texts with each
    term: the lists of all rows add up to the whole.
    """
    held = chunks.select("chunk_id", "text")
    held = embed(held, encoder) if encoder else held
    plain = bool(encoder) and dict(held.dtypes)["vector"] != "array<float>"
    fields = [held.schema["vector"]] if plain else parsed(PACKED).fields
    schema = T.StructType([held.schema["chunk_id"], *fields, *parsed(POSTED).fields, *parsed(SEEN).fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, int] = {}
        seen, before = Seen(), None
        for some, counted in _counted(batches, "text"):
            if before:  # the last rows wait for what is left at the end
                yield _batch(before, seen.full(), schema.names)
            seen.add(counted)
            vectors = [some.column("vector")] if plain else pack(some.column("vector") if encoder else vector_lists(counted.vectors(DIM, buckets)))
            before = [some.column("chunk_id"), *vectors, pa.array(counted.lengths(), pa.int32()), counted.lists()]
        if before:
            yield _batch(before, seen.rest(), schema.names)

    return held.mapInArrow(count, schema)


def _batch(columns: list[pa.Array], seen: pa.StructArray, names: list[str]) -> pa.RecordBatch:
    """Rows of which the first has all that was seen."""
    ends = np.full(len(columns[0]) + 1, len(seen), np.int32)
    ends[0] = 0
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), seen)], names)


class Seen:
    """In how many texts each term stands, added up until there are HELD terms."""

    def __init__(self):
        self.parts: list[pa.Table] = []

    def add(self, counted: Counted) -> None:
        df = np.bincount(counted.term, minlength=len(counted.terms))
        self.parts.append(pa.table({"term": counted.terms.filter(pa.array(df > 0)).cast(pa.string()), "df": df[df > 0]}))

    def full(self) -> pa.StructArray:
        """All so far, if these are HELD terms; then they are forgotten."""
        if sum(p.num_rows for p in self.parts) >= 2 * HELD:
            self.parts = [self._sums()]
            if self.parts[0].num_rows >= HELD:
                return self.rest()
        return pa.array([], KIND)

    def rest(self) -> pa.StructArray:
        sums, self.parts = self._sums(), []
        return pa.StructArray.from_arrays([c.combine_chunks() for c in sums.columns], fields=list(KIND))

    def _sums(self) -> pa.Table:
        if not self.parts:
            return pa.table({"term": pa.array([], pa.string()), "df": pa.array([], pa.int64())})
        return pa.concat_tables(self.parts).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"])


def pack(vectors: pa.ListArray) -> list[pa.Array]:
    """(width, bits, vals) of vectors: a bit for each value, whether it has any bit set, and those that have as they are. Hashed
    vectors are mostly zeros, and lists of single values cost Spark's writer and reader more than all else. A null has no width."""
    width = pc.list_value_length(vectors)
    widths = pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy()
    full = flat.view(np.uint32) != 0
    size, inside = _room(widths)
    padded = np.zeros(len(inside), bool)
    padded[inside] = full
    upto = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(widths)])
    return [width, _binary(np.packbits(padded), np.cumsum(size)), _binary(flat[full], 4 * upto[ends[1:]])]


def _room(widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes the bits of each row take, and which of all their places are in use."""
    size = (widths + 7) // 8
    place = np.arange(8 * size.sum()) - np.repeat(8 * (np.cumsum(size) - size), 8 * size)
    return size, place < np.repeat(widths, 8 * size)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def unpack(width: pa.Array, bits: pa.Array, vals: pa.Array) -> pa.ListArray:
    """The vectors that pack() was given."""
    widths = pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(widths.sum(), np.float32)
    out[np.unpackbits(_bytes(bits))[_room(widths)[1]] == 1] = _bytes(vals).view(np.float32)
    ends = np.concatenate([[0], np.cumsum(widths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=pc.is_null(width))


def _bytes(c: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8)


def vectors_of(written: DataFrame) -> DataFrame:
    """(chunk_id, vector) of written entries."""
    if "vector" in written.columns:
        return written.select("chunk_id", "vector")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(pc.fill_null(b.column("width"), 0).to_numpy(zero_copy_only=False)):
                some = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([some.column("chunk_id"), unpack(*(some.column(c) for c in ("width", "bits", "vals")))], ["chunk_id", "vector"])

    return written.select("chunk_id", "width", "bits", "vals").mapInArrow(read, T.StructType([written.schema["chunk_id"], *parsed("vector array<float>").fields]))


def term_stats(posted: DataFrame, n_docs: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): ln((N - df + 0.5) / (df + 0.5)); negative values become epsilon times the mean over all terms.

    ``n_docs``: one row (n). Of written entries what their tasks have seen is added up.
    """
    if "seen" in posted.columns:
        df = posted.select(F.explode("seen").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("t.df").alias("df"))
    else:
        df = posted.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log((n_docs.scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * mean).otherwise(F.col("raw")).alias("idf"))


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avg_len): number of texts and their mean length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokenize(F.col(text)))).alias("avg_len"))


def posted_stats(posted: DataFrame) -> DataFrame:
    """The same as corpus_stats, from postings, which know each text's length."""
    return posted.agg(*_lengths())


def write_entries(chunks: DataFrame, path: str, encoder=None) -> tuple[DataFrame, DataFrame]:
    """Write the entries of chunks; index_stats and posted_stats of them, which the write has counted."""
    made, seen = entries(chunks, encoder), Observation()
    width = F.col("width") if "width" in made.columns else F.size("vector")
    made.observe(seen, *_widths(width), *_lengths()).write.options(**DENSE).parquet(path)
    counts = seen.get
    told = [F.lit(counts[n]).cast(kind).alias(n) for n, kind in (("chunks", "long"), ("min_dim", "int"), ("max_dim", "int"), ("avg_len", "double"))]
    one = chunks.sparkSession.range(1)
    return one.select(*told[:3]), one.select(told[0].alias("n"), told[3])


def bm25_weight(tf: Column, doc_len: Column, avg_len: Column, idf: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))
