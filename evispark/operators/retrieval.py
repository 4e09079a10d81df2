"""Dense and sparse retrieval for a table of questions, fusion, and reranking. Texts travel only with survivors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .. import policy
from ..functions.text import exploded, tokenize
from ..schemas import parsed
from ..scratch import scratch
from .index import bm25_weight

#: Questions that one task holds at once; with no more in all, they are broadcast. Their terms likewise.
QUESTION_BLOCK = 4096
QUESTION_TERMS = 1 << 17
#: Chunks in a part that meets a block of questions, and scores that are in hand at once.
PART, CELLS = 1 << 16, 1 << 20
#: Chunks that share an upper bound of what a term adds to their scores.
BLOCK = 256
#: Chunks whose postings are scored at once.
SCORED = 8 * BLOCK


def top_by(df: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each question with their rank from 1; tasks keep k each before rows meet."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def few(rows: DataFrame, limit: int) -> list | None:
    """The rows, if there are ``limit`` at most."""
    got = rows.limit(limit + 1).collect()
    return got if len(got) <= limit else None


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The k best (score, key) of each of n questions among those seen, ties by key. ``floor`` has a score of each question that k
    of those seen reach."""

    def __init__(self, k: int, n: int):
        self.k, self.limit = k, max(1 << 18, 4 * n * k)
        self.floor, self.parts, self.size = np.full(n, -np.inf), [], 0

    def add(self, keys: np.ndarray, scores: np.ndarray, above: float = -np.inf, questions: np.ndarray | None = None) -> None:
        """``scores`` (keys x questions, of all or of those numbered); of each only those over ``above`` that can be among its k stay."""
        questions = np.arange(scores.shape[1]) if questions is None else questions
        for j in range(0, scores.shape[1], 256):
            s, q = scores[:, j : j + 256], questions[j : j + 256]
            if len(s) >= self.k:
                kth = -np.partition(-s, self.k - 1, axis=0)[self.k - 1]
                self.floor[q] = np.maximum(self.floor[q], np.where(kth > above, kth, -np.inf))
            row, col = np.nonzero((s >= self.floor[q]) & (s > above))  # ties with the last one stay
            self.parts.append(pd.DataFrame({"q": q[col], "key": keys[row], "score": s[row, col]}))
            self.size += len(row)
        if self.size > self.limit:
            self._compact()

    def _compact(self) -> None:
        held = pd.concat(self.parts).sort_values(["q", "score", "key"], ascending=[True, False, True]).groupby("q").head(self.k)
        self.parts, self.size = [held], len(held)
        full = held.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        at = full.index.to_numpy()
        self.floor[at] = np.maximum(self.floor[at], full["min"].to_numpy())

    def frame(self, ids: list, key: str, score: str) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"query_id": [], key: [], score: []})
        self._compact()
        held = self.parts[0]
        return pd.DataFrame({"query_id": [ids[i] for i in held["q"]], key: held["key"].to_numpy(), score: held["score"].to_numpy()})


def _add_vectors(best: _Best, keys: np.ndarray, vectors: pd.Series, q: np.ndarray, digits: int | None) -> None:
    scores = _unit(np.stack(vectors.to_numpy()).astype(np.float64)) @ q.T
    best.add(keys, scores if digits is None else np.round(scores, digits))


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 25, digits: int | None = None, key: str = "chunk_id", block: int = QUESTION_BLOCK) -> DataFrame:
    """(query_id, key, dense_score, dense_rank): the k chunks with the largest cosine for each question, exactly.

    Up to ``block`` question vectors are broadcast, so that chunks are read where they are. More are dealt to blocks, and
    chunks to parts; each pair of block and part is one task. Every task multiplies chunk vectors with its questions' and
    keeps k for each, so questions times chunks never exist as rows. Ties go by key. With ``digits`` scores are rounded
    before they are ranked.
    """
    kinds = {**dict(chunks.select(key).dtypes), **dict(queries.select("query_id").dtypes)}
    schema = f"query_id {kinds['query_id']}, {key} {kinds[key]}, dense_score double"
    asked = queries.select("query_id", "vector").filter(F.size("vector") > 0)
    held = chunks.select(key, "vector").filter(F.size("vector") > 0)
    rows = few(asked, block)
    if rows is not None:
        found = _dense_broadcast(rows, held, k, digits, key, schema)
    else:
        found = _dense_grid(scratch(asked, "questions"), held, k, digits, key, schema, block)
    return top_by(found, k, F.desc("dense_score"), F.asc(key), name="dense_rank")


def _dense_broadcast(rows: list, chunks: DataFrame, k: int, digits: int | None, key: str, schema: str) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], [r["vector"] for r in rows]))  # QUESTION_BLOCK vectors

    out = to_arrow_schema(parsed(schema))

    def local_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        if not ids:
            return
        q, best = _unit(np.array(vectors, dtype=np.float64)), _Best(k, len(ids))
        step = max(BLOCK, CELLS // max(len(ids), q.shape[-1]))
        for b in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            if b.num_rows:
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                scores = _unit(x) @ q.T
                best.add(np.array(b.column(key).to_pylist()), scores if digits is None else np.round(scores, digits))
        if best.parts:
            yield from pa.Table.from_pandas(best.frame(ids, key, "dense_score"), schema=out, preserve_index=False).to_batches()

    return chunks.mapInArrow(local_top, schema)


def _dense_grid(asked: DataFrame, chunks: DataFrame, k: int, digits: int | None, key: str, schema: str, block: int) -> DataFrame:
    """Blocks of questions against parts of chunks. A block has one row for each part, so a question's vector travels as
    often as there are parts, and a chunk's as often as there are blocks."""
    blocks = max(1, -(-asked.count() * 2 // block))  # dealt by hash to about half of ``block`` each
    held = scratch(chunks, "vectors")
    parts = max(1, -(-held.count() // PART))
    mine, theirs = _dealt(asked, "query_id", blocks, parts), _dealt(held, key, parts, blocks, "part", "block")

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        best = _Best(k, len(q))
        if len(q) and len(c):
            vectors = _unit(np.stack(q["vector"].to_numpy()).astype(np.float64))
            for i in range(0, len(c), 4096):
                _add_vectors(best, c[key].to_numpy()[i : i + 4096], c["vector"].iloc[i : i + 4096], vectors, digits)
        return best.frame(q["query_id"].tolist(), key, "dense_score")

    on = ["block", "part"]
    return mine.groupBy(*on).cogroup(theirs.groupBy(*on)).applyInPandas(pair, schema)


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, term, times): distinct terms of each question and how often it repeats them."""
    return exploded(queries.select("query_id", F.col(text).alias("_text")), tokenize(F.col("_text")), "term").groupBy("query_id", "term").agg(F.count("*").alias("times"))


def sparse_topk(
    terms: DataFrame, posted: DataFrame, idf: DataFrame, stats: DataFrame, k: int = 25, k1: float = 1.5, b: float = 0.75, digits: int = 6, key: str = "chunk_id", most: int = QUESTION_TERMS
) -> DataFrame:
    """(query_id, key, sparse_score, sparse_rank): the k chunks with the largest BM25 score over 0 for each question.

    ``posted`` has a row for each chunk (see index.postings). Up to ``most`` terms of questions with their idf are broadcast, so
    that chunks are scored where they are read; more are dealt to blocks, and chunks to parts, and each pair of both is one
    task. A task knows for each few hundred of its chunks how much each term adds at most, and scores for a question only
    those that can reach its k best so far (see _Scorer), so neither a term's postings nor questions times chunks are ever
    rows. Scores are rounded before ranking, ties go by key.
    """
    wanted = terms.join(idf.select("term", "idf"), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    average = stats.select("avg_len").first()[0]
    kinds = {**dict(posted.select(key).dtypes), **dict(wanted.select("query_id").dtypes)}
    schema = f"query_id {kinds['query_id']}, {key} {kinds[key]}, sparse_score double"
    rows = few(wanted, most)
    held = posted.select(key, "doc_len", "terms")
    how = (average, k, k1, b, digits, key)
    found = _sparse_grid(scratch(wanted, "question-terms"), held, schema, most, how) if rows is None else _sparse_broadcast(rows, held, schema, how)
    return top_by(found, k, F.desc("sparse_score"), F.asc(key), name="sparse_rank")


class _Scorer:
    """The k best chunks for each question of a table of (query_id, term, weight), over batches of postings.

    Of each BLOCK of chunks it knows the largest share that a term has in any; weighed and added up for a question, these are
    more than any of its chunks can score. Blocks that promise most come first; a question skips those that promise less
    than its floor.
    """

    def __init__(self, query_ids: list, terms: list, weights: list, how: tuple):
        self.average, self.k, self.k1, self.b, self.digits, self.key = how
        self.ids = sorted(set(query_ids))
        number = {q: i for i, q in enumerate(self.ids)}
        names = sorted(set(terms))
        place = {t: i for i, t in enumerate(names)}
        self.names = pa.array(names, pa.string())
        question, term = np.array([number[q] for q in query_ids], np.int64), np.array([place[t] for t in terms], np.int64)
        order = np.lexsort((question, term))
        self.question, self.term, self.weight = question[order], term[order], np.array(weights, float)[order]
        self.begin = np.searchsorted(self.term, np.arange(len(names) + 1))
        self.best = _Best(self.k, len(self.ids))

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        lists = batch.column("terms")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        at = pc.index_in(flat.field("term"), self.names)
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        if not len(hit):
            return
        term, doc = at.take(pa.array(hit)).to_numpy().astype(np.int64), doc[hit]
        tf, length = flat.field("tf").to_numpy()[hit].astype(float), batch.column("doc_len").to_numpy()[doc]
        share = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.average))
        keys, bounds = np.array(batch.column(self.key).to_pylist()), self._bounds(term, doc // BLOCK, share, -(-batch.num_rows // BLOCK))
        for block in np.argsort(-bounds.sum(axis=0), kind="stable").tolist():
            asking = np.flatnonzero((bounds[:, block] > 0) & (np.round(bounds[:, block] + 1e-9, self.digits) >= self.best.floor))
            mine = slice(*np.searchsorted(doc, [block * BLOCK, (block + 1) * BLOCK]))
            step = max(1, CELLS // BLOCK)
            for j in range(0, len(asking), step):
                self._score(term[mine], doc[mine] - block * BLOCK, share[mine], keys[block * BLOCK : (block + 1) * BLOCK], asking[j : j + step])

    def _bounds(self, term: np.ndarray, block: np.ndarray, share: np.ndarray, blocks: int) -> np.ndarray:
        """(questions x blocks) more than any chunk of the block scores."""
        there, place = np.unique(term, return_inverse=True)
        largest = np.zeros((len(there), blocks))
        np.maximum.at(largest, (place, block), share)
        out = np.zeros((len(self.ids), blocks))
        asked = self.begin[there + 1] - self.begin[there]
        entry = np.repeat(self.begin[there] - np.cumsum(asked) + asked, asked) + np.arange(asked.sum())
        row = np.repeat(np.arange(len(there)), asked)
        order = np.argsort(self.question[entry], kind="stable")
        entry, row = entry[order], row[order]
        first = np.flatnonzero(np.diff(self.question[entry], prepend=-1))
        for j in range(0, blocks, 64):  # a chunk can lack a term that would take from its score
            added = np.maximum(self.weight[entry], 0)[:, None] * largest[row, j : j + 64]
            out[self.question[entry[first]], j : j + 64] = np.add.reduceat(added, first, axis=0)
        return out

    def _score(self, term: np.ndarray, doc: np.ndarray, share: np.ndarray, keys: np.ndarray, questions: np.ndarray) -> None:
        column = np.full(len(self.ids), -1)
        column[questions] = np.arange(len(questions))
        asked = self.begin[term + 1] - self.begin[term]
        entry = np.repeat(self.begin[term] - np.cumsum(asked) + asked, asked) + np.arange(asked.sum())
        source = np.repeat(np.arange(len(term)), asked)
        use = column[self.question[entry]] >= 0
        entry, source = entry[use], source[use]
        cell = doc[source] * len(questions) + column[self.question[entry]]
        scores = np.round(np.bincount(cell, self.weight[entry] * share[source], len(keys) * len(questions)), self.digits)
        self.best.add(keys, scores.reshape(len(keys), len(questions)), above=0.0, questions=questions)

    def result(self, out: pa.Schema) -> pa.Table:
        frame = self.best.frame(self.ids, self.key, "sparse_score")
        return pa.Table.from_pandas(frame, schema=out, preserve_index=False) if len(frame) else out.empty_table()


def _sparse_broadcast(rows: list, posted: DataFrame, schema: str, how: tuple) -> DataFrame:
    table = ([r["query_id"] for r in rows], [r["term"] for r in rows], [r["weight"] for r in rows])
    shared, out = posted.sparkSession.sparkContext.broadcast(table), to_arrow_schema(parsed(schema))  # QUESTION_TERMS rows at most

    def local_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*shared.value, how)
        for batch in batches if scorer.ids else ():
            for i in range(0, batch.num_rows, SCORED):
                scorer.add(batch.slice(i, SCORED))
        yield from scorer.result(out).to_batches()

    return posted.mapInArrow(local_top, schema)


def _sparse_grid(wanted: DataFrame, posted: DataFrame, schema: str, most: int, how: tuple) -> DataFrame:
    """Blocks of questions, of about ``most`` / 2 terms each, against parts of chunks, as in _dense_grid."""
    blocks = max(1, -(-wanted.count() * 2 // most))
    parts = max(1, -(-posted.count() // PART))
    mine, theirs = _dealt(wanted, "query_id", blocks, parts), _dealt(posted, how[-1], parts, blocks, "part", "block")
    out = to_arrow_schema(parsed(schema))

    def pair(q: pa.Table, c: pa.Table) -> pa.Table:
        if not (q.num_rows and c.num_rows):
            return out.empty_table()
        scorer = _Scorer(q.column("query_id").to_pylist(), q.column("term").to_pylist(), q.column("weight").to_pylist(), how)
        for batch in c.to_batches(SCORED):
            scorer.add(batch)
        return scorer.result(out)

    return mine.groupBy("block", "part").cogroup(theirs.groupBy("block", "part")).applyInArrow(pair, schema)


def _dealt(rows: DataFrame, key: str, groups: int, copies: int, group: str = "block", copy: str = "part") -> DataFrame:
    """Rows dealt to ``groups`` by a hash of their key, each once for every one of ``copies``."""
    numbered = rows.withColumn(group, F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    return numbered.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k0: int = 60, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rrf_score, retrieved_by, dense_rank, sparse_rank, fused_rank) of both lists together."""
    none = F.lit(None).cast("int")
    both = dense.select("query_id", key, "dense_rank", none.alias("sparse_rank")).unionAll(sparse.select("query_id", key, none.alias("dense_rank"), "sparse_rank"))
    one = both.groupBy("query_id", key).agg(F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (k0 + F.col(c)), F.lit(0.0))
    by = F.when(F.col("sparse_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "sparse").otherwise("hybrid")
    fused = one.withColumn("rrf_score", share("dense_rank") + share("sparse_rank")).withColumn("retrieved_by", by)
    order = [F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc(key)]
    return fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rerank_idf(df_by_term: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, weight): ln(1 + N / (1 + df)), as the lexical reranker weighs terms."""
    return df_by_term.select("term", F.log(1 + stats.select("n").scalar() / (1 + F.col("df"))).alias("weight"))


def lexical_rerank(candidates: DataFrame, queries: DataFrame, weights: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``candidates`` (query_id, key, text, ...) with rerank_score: the weight of shared terms over that of all terms.

    Terms are distinct; one that the corpus lacks weighs 1. A question without terms scores 0.
    """
    terms = exploded(queries.select("query_id", "query"), F.array_distinct(tokenize(F.col("query"))), "term")
    weighed = terms.join(weights, "term", "left").select("query_id", "term", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    listed = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_terms"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["weight"])
    # terms of both by hash; the weights of those few in the order of the terms
    both = F.array_intersect(F.transform("_terms", lambda t: t["term"]), tokenize(F.col("text")))
    shared = F.flatten(F.transform(F.array(both), lambda own: F.filter("_terms", lambda t: F.array_contains(own, t["term"]))))
    total = add(F.col("_terms"))
    score = F.coalesce(add(shared) / F.when(total == 0, 1.0).otherwise(total), F.lit(0.0))
    return candidates.join(listed, "query_id", "left").withColumn("rerank_score", score).drop("_terms")


def rerank(candidates: DataFrame, n: int = 5, scorer: Callable[[Column, Column], Column] | None = None, digits: int = 6) -> DataFrame:
    """The n best candidates of each question with rank from 1; ties keep the order before.

    ``scorer`` gives a score column from (query, text) columns; without it rerank_score must be there.
    """
    scored = candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))) if scorer else candidates
    scored = scored.withColumn("rerank_score", F.round("rerank_score", digits))
    return top_by(scored, n, F.desc("rerank_score"), F.asc("fused_rank"))


def age_conflicts(chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """(type, nct_id, key, structured_min_age, stated_in_text, message): one row for each chunk that states an age three
    or more years off the declared minimum. The first such statement counts; without a declared age there is none."""
    stated = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(policy.AGE_IN_TEXT), F.lit(1)), lambda x: x.cast("double"))
    declared = F.col("min_age_years").try_cast("double")
    off = F.filter(stated, lambda x: F.abs(x - declared) >= 3)
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    message = F.format_string(policy.AGE_ALERT, F.coalesce("nct_id", F.lit("None")), whole(F.col("structured_min_age")), whole(F.col("stated_in_text")))
    return (
        chunks.select("nct_id", key, declared.alias("structured_min_age"), F.try_element_at(off, F.lit(1)).alias("stated_in_text"))
        .filter("stated_in_text IS NOT NULL")
        .select(F.lit("ELIGIBILITY_AGE_CONFLICT").alias("type"), "*", message.alias("message"))
    )


