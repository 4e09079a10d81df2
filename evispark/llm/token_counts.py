"""Token counts from pre-tokens: each distinct pre-token is counted once, documents only add up."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .pieces import SPACE_MARK, PieceModel

#: Bytes of pre-tokens that are broadcast at most.
HOT_BYTES = 32 << 20


def _pieces(batches: Iterator[pd.DataFrame], model: PieceModel) -> Iterator[pd.DataFrame]:
    lone = [p[0] for p in model.pieces].index(SPACE_MARK) if model.cuts else None
    for b in batches:
        tokens = b["token"].tolist()
        if lone is None:
            n = [len(e.ids) for e in model.core.encode_batch_fast(tokens, add_special_tokens=False)]
        else:  # the library puts the first space itself, but nothing before nothing
            n = [len(x) or 1 for x in model.library.encode([t[1:].replace(SPACE_MARK, " ") for t in tokens])]
        yield b.assign(pieces=n)


def count_tokens(docs: DataFrame, model: PieceModel, limit: int = 4096, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Every document's n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), with its doc_id.

    Pre-tokens are runs of spaces with what follows them; no piece crosses their borders, so a text's tokens are the
    sum over its pre-tokens (a model without that property has the whole text as one). Null and empty texts have 0.

    A pre-token is hot if it stands at least (bytes of all pre-tokens / hot_bytes) times in the corpus: together the
    hot ones have ``hot_bytes`` at most, whatever the corpus, so their counts are broadcast. The others are joined to
    per-document frequencies by a shuffle in which no key is frequent. Rows are told apart by a row key, so repeated
    doc_ids, null doc_ids and equal texts each keep their own row. A long text is counted whole, by one task. An empty
    table gives no rows; other columns are not read, so none can clash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = spark.sparkContext.broadcast(model.raw)  # the model file

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(raw.value)
        for whole in batches:
            for b in slices(whole, "text"):
                seen: Counter = Counter()
                for t in b.column("text").to_pylist():
                    seen.update(own.cut_plainly(t or ""))
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _pieces(batches, PieceModel(raw.value))

    vocabulary = written(
        rows.select("text")
        .mapInArrow(frequencies, "token string, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .mapInPandas(counted, "token string, n long, pieces long"),
        "vocabulary",
    )
    total = vocabulary.agg(F.sum(F.col("n") * F.octet_length("token"))).first()[0] or 0
    hot = vocabulary.filter(F.col("n") * F.lit(hot_bytes) >= F.lit(total))
    table = spark.sparkContext.broadcast({r.token: r.pieces for r in hot.select("token", "pieces").toLocalIterator()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = PieceModel(raw.value), table.value
        for whole in batches:
            for b in slices(whole, "text"):
                size, tokens, rest = [], [], []
                for t in b.column("text").to_pylist():
                    found, others = 0, []
                    for token, n in Counter(own.cut_plainly(t or "")).items():
                        if (pieces := known.get(token)) is not None:
                            found += n * pieces
                        else:
                            others.append((token, n))
                    size.append(len((t or "").encode()))
                    tokens.append(found)
                    rest.append(others)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), _pairs(rest)],
                    ["doc_id", "n_bytes", "found", "rest"],
                )

    partly = written(
        rows.mapInArrow(summed, "doc_id long, n_bytes long, found long, rest array<struct<token: string, n: long>>").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "partly-counted",
    )
    cold = vocabulary.filter(F.col("n") * F.lit(hot_bytes) < F.lit(total)).select("token", "pieces")
    more = (
        partly.select("row", F.explode("rest").alias("r"))
        .select("row", "r.token", "r.n")
        .join(cold, "token")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    n_tokens = F.col("found") + F.coalesce("more", F.lit(0))
    return (
        partly.drop("rest")
        .join(more, "row", "left")
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
    )


def _pairs(rows: list[list[tuple[str, int]]]) -> pa.Array:
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    kind = pa.struct([("token", pa.string()), ("n", pa.int64())])
    flat = pa.StructArray.from_arrays(
        [pa.array([t for r in rows for t, _ in r], pa.string()), pa.array([n for r in rows for _, n in r], pa.int64())],
        fields=list(kind),
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
