"""The pipeline's stages, one after another, against plain models."""

import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from evispark.llm import oracles, queries
from evispark.llm.common import written

from ..oracle import spark_rows
from . import helpers as H

ROWS = H.awkward(4)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    H.frame(spark, ROWS).write.parquet(f"{at}/documents.parquet")
    good = [(r[0], 1, 0) for r in ROWS if r[0] is not None and r[0] < 400] + [(601, 0, 0), (403, 0, 1)]
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def chain(spark, folder):
    """What goes into each stage and what comes out, as the driver runs them."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        result = written(stage(spark, docs, folder), "stage")
        out.append((name, docs, result))
        docs = result
    return out


def rows(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_stages_keep_the_columns_of_documents(chain):
    assert [n for n, *_ in chain] == ["quality rules", "near dedup", "substring dedup", "source mix", "sentencepiece"]
    for _, docs, result in chain[:-1]:
        assert result.columns == P.COLUMNS and result.count() <= 3 * docs.count()


def test_quality_stage_drops_what_fails(chain):
    _, docs, result = chain[0]
    kept = {r.doc_id for r in result.collect()}
    for i, t, *_ in ROWS:
        n, *_, repeated = H.base_counts(t)
        if i not in (None, 500) and (n < 10 or 100 * repeated > 20 * n):  # ids with several texts aside
            assert i not in kept
    assert {100, 200, 300, 600} <= kept and set(rows(result)) <= set(rows(docs))


def test_near_dedup_stage_keeps_one_of_each_group(chain):
    _, docs, result = chain[1]
    before = rows(docs)
    group = {k: c for k, _, c in H.groups([(k, *r[1:]) for k, r in enumerate(before)])}
    best = {}
    for k, r in enumerate(before):
        best.setdefault(group[k], []).append((r[0] is None, r[0] or 0))
    expected = sorted(((min(x)[1] if not min(x)[0] else None) for x in best.values()), key=str)
    assert sorted((r[0] for r in rows(result)), key=str) == expected and set(rows(result)) <= set(before)


def test_near_dedup_looks_at_rows_not_at_doc_ids(spark, folder):
    rng = random.Random(8)
    base, other = H.prose(rng, 80), H.prose(rng, 80)
    given = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, other, "en", "a", 1), (7, f"{base} more", "en", "a", 1), (None, base, "en", "a", 1)]
    given += [(9, H.prose(rng, 60), "de", "b", 1)] * 3 + [(None, H.prose(rng, 60), "de", "b", 1)]
    got = sorted((r[0] for r in rows(P.near_dedup(spark, H.frame(spark, given), folder))), key=str)
    assert got == [1, 2, 9, None]


def test_stages_take_tables_with_clashing_columns(spark, folder, chain):
    """Other columns with names that operators use change nothing and are left behind."""
    for (_, docs, result), (_, stage) in zip(chain, P.STAGES, strict=True):
        clash = docs.select("*", *[F.lit("mine").alias(c) for c in "size h skey key mine row part n_words kept copies quality ids component_id text_a".split()])
        again = stage(spark, clash, folder)
        assert again.columns == result.columns
        assert spark_rows(again.select("doc_id")) == spark_rows(result.select("doc_id"))


def test_substring_stage_cuts_repeats(chain):
    _, docs, result = chain[2]
    expected = {(i, n - gone) for i, n, gone, _ in H.windows(rows(docs)) if not n or gone < n}
    assert {(r[0], len(H.words(r[1]))) for r in rows(result)} == expected
    assert any(gone for _, _, gone, _ in H.windows(rows(docs))) and all(r[4] == len(r[1]) for r in rows(result) if r[1] is not None)


def test_mix_stage_repeats_and_leaves_out(chain):
    """Every row as often as the SQL of the mix takes it, with all columns in a row's hash, as the stage has them."""
    _, docs, result = chain[3]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    named = oracles.mixing().replace("coalesce(md5(text), ''))) AS key", "coalesce(md5(text), ''), coalesce(lang, ''), coalesce(n_chars::VARCHAR, ''))) AS key")
    named = named.replace("PARTITION BY doc_id, source, text)", "PARTITION BY doc_id, source, text, lang, n_chars)").replace("SELECT doc_id, source, coalesce('s'", "SELECT doc_id, text, lang, n_chars, source, coalesce('s'")
    taken = con.execute(named.replace("SELECT doc_id, size, source_size, target, (size", "SELECT doc_id, text, lang, source, n_chars, (size")).fetchall()
    expected = Counter()
    for *row, _, copies in taken:
        expected[tuple(row)] += copies
    assert Counter(rows(result)) == +expected and len(taken) == docs.count()


def test_encoding_stage(chain):
    _, docs, result = chain[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    expected = sorted(((r.doc_id, sp.encode(r.text or "")) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.ids) for r in result.collect()), key=str) == expected


def test_run_is_the_stages_in_order(spark, folder, chain):
    got = P.run(spark, folder)
    assert spark_rows(got.select("doc_id", "n_tokens", "decoded_sha256")) == spark_rows(chain[-1][2].select("doc_id", "n_tokens", "decoded_sha256"))


def test_nothing_in_nothing_out(spark, folder, tmp_path):
    docs = H.frame(spark, [])
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, folder), "empty")
        assert docs.count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
