"""The index job's single pass over texts, its packed vectors, and what it leaves on disk."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.functions.phi import is_gated, unicode_words
from evispark.functions.splitting import split_rows, split_text, with_overlap
from evispark.functions.text import WHITE, strip, tokenize
from evispark.functions.vectors import counted_terms, hash_embed
from evispark.jobs import workloads
from evispark.jobs.workloads import Index, build_index
from evispark.operators import index
from evispark.policy import GATED_FAMILIES, PHI_PATTERNS
from evispark.scratch import lent, scratch
from evispark.sources.numbers import counted_in_order
from evispark.streaming import events as ev

ODD = ["", " ", "\x1c ", "a", "İI Kelvin K ſ straße 12", " x　", "one. two\n\nthree", "aaa " * 50, "tail\x1f", None, "᠎b ", "12AB-cd_ef"]


def test_split_rows_as_columns(spark):
    long = ["w%d. " % i * (i % 7) + "\n" * (i % 4) + "y" * (i % 90) for i in range(60)]
    texts = ODD + [" ".join(long), "\n\n".join(long), "é" * 130 + " " + "z" * 30, ". ".join(["ab\x1c"] * 60), "\n\n\n" + "q " * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    plain = df.select("i", split_text(F.col("t"), 50).alias("p")).select("i", F.posexplode(with_overlap("p", 20)).alias("chunk_index", "_piece"))
    got = split_rows(df, "t", 50, 20)
    assert got.columns == ["i", "chunk_index", "_piece"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    headed = split_rows(df.withColumn("h", F.lit("\x1c[H] ")), "t", 50, 20, "h")
    stripped = plain.select("i", "chunk_index", strip(F.concat(F.lit("\x1c[H] "), "_piece")).alias("_piece"))
    assert sorted(map(tuple, headed.collect())) == sorted(map(tuple, stripped.collect()))


def test_white_space_is_that_of_the_patterns(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").filter(F.col("c").rlike(r"(?U)\s")).collect()
    assert sorted(r.c for r in rows) == sorted(WHITE)


def test_counted_terms_are_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select(tokenize(F.col("t")).alias("k")).collect()
    counted = counted_terms(ODD)
    for r, pairs in zip(rows, counted.lists().to_pylist()):
        assert sorted((p["term"], p["tf"]) for p in pairs) == sorted((k, r.k.count(k)) for k in set(r.k))
    assert counted.lengths().tolist() == [len(r.k) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.just(0.0), st.floats(width=32)), max_size=20)), max_size=8), st.integers(0, 3))
def test_pack(lists, at):
    x = pa.array(lists, pa.list_(pa.float32())).slice(at)
    got = index.unpack(*index.pack(x))
    assert got.is_null().to_pylist() == x.is_null().to_pylist()
    assert got.fill_null([]).value_lengths().to_pylist() == x.fill_null([]).value_lengths().to_pylist()
    assert np.array_equal(got.flatten().to_numpy().view(np.uint32), x.flatten().to_numpy().view(np.uint32))  # -0.0 and NaN as they are


@pytest.mark.parametrize("held", [1, 3, 1 << 17])
def test_entries_agree_with_single_steps(spark, monkeypatch, held):
    texts = [f"w{i % 7} w{i % 3} w{i} " * (1 + i % 4) for i in range(40)] + ["", "w0"]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)
    monkeypatch.setattr(index, "HELD", held)
    at = scratch(index.entries(chunks), "entries")
    assert not [c for c, t in at.dtypes if "float" in t]  # no list of single values is written for vectors
    assert sorted(map(tuple, index.vectors_of(at).collect())) == sorted(map(tuple, index.embed(chunks).select("chunk_id", "vector").collect()))
    posted = scratch(index.postings(chunks), "postings")
    ordered = lambda df: sorted((r.chunk_id, r.doc_len, sorted(map(tuple, r.terms))) for r in df.collect())
    assert ordered(at) == ordered(posted)
    stats = scratch(index.posted_stats(posted), "stats")
    assert sorted(map(tuple, index.term_stats(at, stats.select("n")).collect())) == sorted(map(tuple, index.term_stats(posted, stats.select("n")).collect()))


def test_seen_is_let_go():
    seen = index.Seen()
    for _ in range(3):
        seen.add(counted_terms(["a b", "b c"]))
        assert len(seen.full()) == 0  # far fewer than are held
    assert sorted((r["term"], r["df"]) for r in seen.rest().to_pylist()) == [("a", 3), ("b", 6), ("c", 3)]
    assert len(seen.rest()) == 0 and index.Seen().rest().to_pylist() == []


def _records(spark, n):
    body = "Some words of a summary. " * 60
    t = spark.range(n).select(
        F.format_string("NCT%08d", "id").alias("nct_id"), F.lit("title").alias("brief_title"), F.concat(F.lit(body), F.col("id").cast("string")).alias("brief_summary"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("overall_status", "string"), ("phase", "string"), ("conditions", "string"), ("sex", "string"), ("eligibility_criteria", "string"))),
        *(F.lit(None).cast(k).alias(c) for c, k in (("interventions", "string"), ("min_age_years", "double"), ("max_age_years", "double"), ("enrollment", "double"), ("source_url", "string"))),
        *(F.lit(None).cast("string").alias(c) for c in ("last_update", "data_quality_flags")),
    )
    a = spark.range(n).select(
        F.col("id").cast("string").alias("pmid"), F.lit("t").alias("title"), F.concat(F.lit(body), F.lit("mail a@b.example "), F.col("id").cast("string")).alias("abstract"),
        *(F.lit(None).cast("string").alias(c) for c in ("journal", "publication_types", "authors", "doi", "source_url", "data_quality_flags")), F.lit(2020).alias("pub_year"),
    )
    return t, a


def test_index_of_doubles_and_of_no_chunks(spark, tmp_path):
    """A plug-in encoder of doubles keeps its type; an index over nothing has statistics of nothing."""
    t, a = _records(spark, 5)
    wide = lambda c: F.array(F.length(c) / 3.0, F.lit(0.0).cast("double"))
    chunks, blocked = build_index(t, a, f"{tmp_path}/i", ("x", "y"), encoder=wide)
    held = Index.open(spark, f"{tmp_path}/i")
    assert dict(held.vectors.dtypes)["vector"] == "array<double>" and blocked.count() == 5
    assert sorted(map(tuple, held.vectors.collect())) == sorted(map(tuple, chunks.select("chunk_id", wide(F.col("text"))).collect()))
    assert tuple(held.dims.first()) == (chunks.count(), 2, 2)
    build_index(t.limit(0), a.limit(0), f"{tmp_path}/none", ("x", "y"))
    none = Index.open(spark, f"{tmp_path}/none")
    assert tuple(none.dims.first()) == (0, None, None) and tuple(none.stats.first()) == (0, None) and none.terms.count() == none.vectors.count() == 0


def test_vectors_of_index(spark, tmp_path):
    t, a = _records(spark, 20)
    chunks, _ = build_index(t, a, f"{tmp_path}/i", ("x", "y"))
    held = Index.open(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, held.vectors.collect())) == sorted(map(tuple, chunks.select("chunk_id", hash_embed(F.col("text")).alias("vector")).collect()))


def _shuffled(spark):
    """Bytes of shuffle files that are on disk."""
    at = spark.conf.get("spark.local.dir")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names if re.match(r"shuffle_.*\.data$", f))


def test_shuffle_files_go_with_the_write(spark):
    spark._jvm.System.gc()
    before = _shuffled(spark)
    df = spark.range(200_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).repartition(7, "id")
    held = scratch(df, "swept")
    with lent(df, "swept") as rows:
        assert rows.count() == held.count() == 200_000
    assert _shuffled(spark) - before < 1 << 20  # 13 MB each stayed
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("MRNmrn-1290 \n\t@a.AbStreetRoadAve١ x"), max_size=40), min_size=1, max_size=30))
def test_gate_misses_nothing(spark, texts):
    some = texts + ["12 North St", "1 Abc\nRd", "MRN-12345", "mrn1234", "123-45-6789", "١٢٣-45-6789", "1234567890", "2١" + "1" * 8, "x@y.zz", "77 Market Road", "no"]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    full = F.lit(False)
    for family in GATED_FAMILIES:
        full = full | F.col("t").rlike(unicode_words(PHI_PATTERNS[family]))
    assert df.filter(is_gated(F.col("t")) != full).count() == 0


def test_numbers_of_tasks_need_no_worker_and_no_shuffle(spark):
    rows = spark.range(1000).repartition(5)
    held, n = counted_in_order(rows, "seq")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "BroadcastHashJoin" in plan and "ExistingRDD" not in plan
    assert n == 1000 and sorted(r.seq for r in held.collect()) == list(range(1000))
    empty, none = counted_in_order(rows.limit(0), "seq")
    assert none == 0 and empty.columns == ["id", "seq"] and empty.count() == 0


def test_published_payload_is_the_row(spark, tmp_path):
    """Texts that look like the end of a payload stay as they are."""
    texts = ['a,"_offset":7}', "", None, 'b"_offset":1}\n']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    assert ev.publish_rows(rows, f"{tmp_path}/e", "x", "s") == 4
    got = spark.read.parquet(f"{tmp_path}/e").orderBy("offset").collect()
    assert [json.loads(r.payload) for r in got] == [{"i": i, "t": t} for i, t in enumerate(texts)] and [r.offset for r in got] == [0, 1, 2, 3]


def test_store_in_rounds(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = index.ChunkStore(spark, f"{tmp_path}/c", 7)
    written = store.write(rows, rounds=3)
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, rows.collect()))
    assert len(written.inputFiles()) == 7  # one file a bucket
    plan = rows.select("chunk_id").hint("shuffle_hash").join(written, "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # what is joined moves, chunks don't
    twice = index.ChunkStore(spark, f"{tmp_path}/d", 7)
    with pytest.raises(index.DuplicateChunks):
        twice.write(rows.unionAll(rows.limit(1)), rounds=3)
    assert store.write(rows.limit(2), reset=True, rounds=20).count() == 2


def test_large_index_is_shuffled_in_rounds(spark, tmp_path, monkeypatch):
    t, a = _records(spark, 30)
    asked = []
    write = index.ChunkStore.write
    monkeypatch.setattr(index.ChunkStore, "write", lambda self, chunks, **k: asked.append(k["rounds"]) or write(self, chunks, **k))
    whole, _ = build_index(t, a, f"{tmp_path} ä/a", ("x", "y"))
    monkeypatch.setattr(workloads, "ROUND", 2000)
    parts, _ = build_index(t, a, f"{tmp_path} ä/b", ("x", "y"))
    assert asked[0] == 1 and asked[1] > 1
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert build_index(t.limit(0), a.limit(0), f"{tmp_path}/none", ("x", "y"))[0].count() == 0
