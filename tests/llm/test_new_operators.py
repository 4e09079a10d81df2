"""Line dedup, alignment and periodic runs against plain models, over awkward documents, with clashing columns and over nothing."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evispark.llm import align, lines, periods
from evispark.llm.common import Words, slices
from evispark.llm.pieces import PieceModel
from evispark.llm.queries import BYTE_MODEL, MODEL

from . import helpers as H

ROWS = H.awkward()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


# 11
def line_rows():
    rng = random.Random(2)
    stock = [f"line number {i} of the stock" for i in range(30)] + ["Short", "UPPER and lower ÄÖ text", "  \tupper AND LOWER äö text\r", "upper and LOWER ÄÖ text \x0b"]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(100 + i, f"own line of {i}\na very common line\na very common line\n\n") for i in range(300)]  # a hot key
    rows += [(500, None), (501, ""), (502, "\n"), (503, "a very common line"), (None, "a very common line\nline number 1 of the stock"), (504, "\n" * 50)]
    rows += [(7, "line number 3 of the stock\nits own"), (7, "line number 3 of the stock\nits own"), (505, "ten chars!\nnine char"), (506, "ten chars!\nnine char")]
    rows += [(600, "\n".join(f"long text {i % 700}" for i in range(5000))), (601, "\n".join(f"long text {i % 900}" for i in range(5000)))]
    return rows + [(1000 + i, r[1]) for i, r in enumerate(ROWS)]


def deduped(rows, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                first[key(x)] = min(i, first.get(key(x), i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        keep = [i is None or not first.get(key(x), i) < i for x in all_lines]
        kept = "\n".join(x for x, k in zip(all_lines, keep, strict=True) if k)
        out.append((i, len(keep), keep.count(False), sha(kept), bits(keep), kept))
    return sorted(out, key=str)


def bits(keep):
    runs, current = [0], True
    for k in keep:
        if k != current:
            runs.append(0)
            current = k
        runs[-1] += 1
    return runs


def line_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("part", [lines.PART, 2])  # 2: every key with three lines is hot
def test_line_dedup(spark, part, monkeypatch):
    monkeypatch.setattr(lines, "PART", part)
    if part == 2:
        monkeypatch.setattr(lines, "HOT", 10**6)
    rows = line_rows()
    clashing = line_frame(spark, rows).selectExpr("*", *(f"'mine' AS {c}" for c in "row gone lines keep h1 h2 pos part head first key".split()))
    out = lines.dedup(clashing)
    assert got(out, "n_lines", "n_dropped", "kept_sha256", "keep", "kept_text") == deduped(rows)
    assert {r.part for r in out.select("part").distinct().collect()} == {"mine"}
    assert lines.dedup(line_frame(spark, rows).filter("false")).count() == 0


def test_hot_lines_are_dealt_to_several_parts(spark):
    rows = [(i, "the same line everywhere\n" + "\n".join(f"line {i} {k} of its own" for k in range(3))) for i in range(2000)]
    docs = line_frame(spark, rows).withColumn("row", F.lit(0).cast("long"))
    hot = lines.hot_keys(lines.line_hashes(docs)).collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r.parts, r["head"]) for r in hot] == [(-(-2000 // (8000 // (lines.HOT * tasks))), 0)]
    assert lines.dropped_lines(lines.line_hashes(docs)).count() == 1999


# 12
@pytest.fixture(scope="module")
def models():
    return align.ByteModel.load(public_tokenizers.path(BYTE_MODEL)), PieceModel.load(public_tokenizers.path(MODEL))


ODD = [
    *("", None, " ", "  ", "\n", " \n ", "a", "word  two   three\n\n four \t five six　seven  x", "x\x1c\x1d !\x1c! y", "don't I'll WE'VE '"),
    *("▁ here", "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "漢字仮名交じり文 と English", "😀😀 👩‍👩‍👧 é é", "1234567890 3.14 1,000,000", "=" * 500),
    *("ab" * 400, " " * 1000 + "x", "​﻿᠎ x \u0085 y", "a b c  d", "\x00 \x01\x02 \x7f z\x00\n\x00", "tab\tsep\r\n line", "नमस्ते दुनिया", "مرحبا بالعالم", "�  \U0010ffff"),
]


def align_rows():
    rng, letters = random.Random(5), "ab cdé\n\t .,'漢    😀1"
    rows = list(enumerate(ODD))
    rows += [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))) for i in range(200)]
    rows += [(900, "".join(rng.choice(letters) for _ in range(100_000))), (901, " ".join(rng.choice(["alpha", "beta", "don't", "x1y2"]) for _ in range(30_000)))]
    return rows + [(None, "a null id"), (7, "the same id"), (7, "the same id"), (902, "y" * 150_000)]


def aligned(rows):
    """Ids from whole texts, groups by the offsets where both sides end, counts over all documents."""
    tokens = Tokenizer.from_file(public_tokenizers.path(BYTE_MODEL))
    tokens.encode_special_tokens = True
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def ends(parts):
        out = [0]
        for p in parts:
            out.append(out[-1] + len(p))
        return out[1:]

    docs, counts = [], Counter()
    for i, t in rows:
        groups = []
        if t:
            a, b = tokens.encode(f" {t}", add_special_tokens=False).ids, library.encode(t)
            spelt_a = [bytes(byte[c] for c in tokens.id_to_token(x)) for x in a]
            spelt_b = [bytes([int(library.id_to_piece(x)[3:5], 16)]) if library.is_byte(x) else library.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(spelt_a) == f" {t}".encode() == b"".join(spelt_b):
                ea, eb = ends(spelt_a), ends(spelt_b)
                ia = ib = 0
                for cut in sorted(set(ea) & set(eb)):
                    ja, jb = ea.index(cut, ia) + 1, eb.index(cut, ib) + 1
                    groups.append((a[ia:ja], b[ib:jb]))
                    ia, ib = ja, jb
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(links.keys())
        docs.append((i, groups, links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups, links in docs:
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sums = sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items())
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), *sums, sha(listed) if groups else ""))
    return sorted(out, key=str)


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 50])  # 50: most pairs are joined
def test_alignment(spark, models, hot):
    rows = align_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", *(f"'mine' AS `{c}`" for c in "row offset side ids pair n best".split()))
    assert got(align.align(df, *models, hot_pairs=hot), *ALIGNED) == aligned(rows)
    assert align.align(df.filter("false"), *models).count() == 0


def test_runs_of_events_make_no_difference(spark, models):
    """Runs of 64 bytes, batches of 3 rows: documents and groups go on from batch to batch; sorted by offset, A before B."""
    rows = [(i, t) for i, t in align_rows() if t is None or len(t) < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        linked = align.sweep(align.end_events(docs, *models, window=64), *models)
        assert got(linked, "n_a", "n_b", "n_groups", "n_links", "groups_sha256") == sorted((r[:5] + r[7:] for r in aligned(rows)), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_workers_that_sweep_get_no_model(spark, models, monkeypatch):
    import pickle

    events = align.end_events(spark.createDataFrame([(1, 1, "a b")], "row long, doc_id long, text string"), *models)
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or real(self, value))
    assert align.sweep(events, *models).count() == 1
    assert sum(sent) < len(models[0].raw) / 2


def test_tokens_are_made_of_few_strings_at_once(models):
    import pyarrow as pa

    tokens, sizes = align.Tokens(*models), []
    for name in ("a", "_encode_b"):
        held = getattr(tokens, name)

        def noting(parts, real=held.encode if name == "a" else held):
            sizes.append(len(parts))
            return real(parts)

        setattr(tokens, name, type("Noting", (), {"encode": staticmethod(noting)}) if name == "a" else noting)
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(100)]
    fine, sides = tokens.of(pa.array(texts, pa.large_string()))
    plain = align.Tokens(*models)
    assert fine.all() and max(sizes) <= align.TOGETHER < sum(sizes) / 4
    for i in (0, 99):
        _, alone = plain.of(pa.array([texts[i]], pa.large_string()))
        assert [ids[at[i] : at[i + 1]].tolist() for ids, at in sides] == [ids.tolist() for ids, _ in alone]


def test_segments_of_most_slices_stay_remembered(models, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(align, "REMEMBERED", 40)
    tokens, learnt = align.Tokens(*models), Counter()
    real = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda fresh: learnt.update(fresh.to_pylist()) or real(fresh))
    for i in range(20):
        texts = pa.array([" ".join(f"{w} w{i}x{j}" for j, w in enumerate(("alpha", "don't", "é", "ß\u3000x", "▁y"))), "", "a\n \x00"], pa.large_string())
        fine, sides = tokens.of(texts)
        plain, theirs = align.Tokens(*models).of(texts)
        assert fine.tolist() == plain.tolist() == [False, True, True]  # the marker is read as a space
        assert [x.tolist() for side in sides for x in side] == [x.tolist() for side in theirs for x in side]
    assert len(learnt) > 100 and max(learnt.values()) == 1


def test_lists_are_sliced_by_their_bytes():
    import pyarrow as pa

    lists = [[1] * 300, None, [], [2] * 10, [3] * 2000, [4]]
    parts = list(slices(pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["x"]), "x", 1000))
    assert [v for p in parts for v in p.column("x").to_pylist()] == lists and len(parts) > 2
    assert [p.num_rows for p in slices(pa.RecordBatch.from_arrays([pa.array([[1]] * 100, pa.list_(pa.int32()))], ["x"]), "x", 200)] == [50, 50]


def test_links_of_a_large_group(monkeypatch):
    import numpy as np

    ids = (np.array([1, 2, 2, 3, 9], np.uint16), np.array([4, 4, 5, 8], np.uint16))
    starts, counts, doc = (np.array([0, 4]), np.array([0, 3])), (np.array([4, 1]), np.array([3, 1])), np.array([6, 7])
    every = align.link_pairs(ids, starts, counts, doc)
    monkeypatch.setattr(align, "SPREAD", 2)
    assert [x.tolist() for x in align.link_pairs(ids, starts, counts, doc)] == [x.tolist() for x in every]
    assert every[1].sum() == 13 and dict(zip(*(x.tolist() for x in every), strict=True))[6 << 32 | 2 << 16 | 4] == 4


def test_other_models_are_refused(models):
    with pytest.raises(ValueError, match="byte-level"):
        align.ByteModel.load(public_tokenizers.path("word_bpe_49k.json"))


# 13
def runs_of(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def looped_words(i, words):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def digests(i, text):
    w = looped_words(i, H.words(text))
    runs = runs_of(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic_rows():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randrange(300)))) for i in range(150)]
    for i in range(200, 300):  # stretches with periods up to 40 one after another
        w = []
        while len(w) < 500:
            unit = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 40))]
            w += [unit[k % len(unit)] for k in range(rng.randrange(1, 9 * len(unit)))] + [rng.choice("xyz")] * rng.randrange(3)
        rows.append((i, " ".join(w)))
    rows += [(301, "one two " * 3), (302, "one two three " * 4), (303, "x " * 6), (304, "x " * 5), (305, "same " * 3000), (306, " ".join(str(k % 700) for k in range(3000)))]
    return rows + [(r[0], r[1] if r[0] != 600 else None) for r in ROWS]


def test_periodic_runs(spark):
    rows = periodic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.select("doc_id", periods.looped(F.col("doc_id"), F.col("text")).alias("text"), F.lit("mine").alias("n_words"), F.lit("mine").alias("lines"))
    out = periods.run_digests(periods.collapse(df))
    assert got(out, *out.columns[1:]) == sorted((digests(i, t) for i, t in rows), key=str)
    assert any(h % 10 == 0 for h in (zlib.crc32(str(i).encode()) for i, _ in rows if i is not None))
    assert periods.collapse(df.filter("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=6), st.integers(1, 30))
def test_runs_of_any_words(texts, times):
    import pyarrow as pa

    texts = [*texts, texts[0] * times]  # a run, if it has one, of long period
    found = periods.find_runs(Words(pa.array([" ".join(t) for t in texts])))
    assert found == [runs_of(t) for t in texts]


def test_stretches_of_ones():
    assert list(periods.stretches(0b0111011110, 3)) == [(1, 4), (6, 3)]
    assert list(periods.stretches(0b1111, 5)) == [] and list(periods.stretches(1, 1)) == [(0, 1)]
