import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark import policy, queries
from evispark.functions import phi, vectors
from evispark.functions.splitting import split_pieces, split_text, with_overlap
from evispark.operators import answers, fhir, flatten, governance, index, lists, quality, retrieval
from evispark.operators.chunking import chunk_articles, chunk_trials
from evispark.queries import articles, notes, trials
from evispark.schemas import ARTICLE, PATIENT, STUDY, TRIAL, parsed

from .conftest import SF


def trial(seq, **over):
    row = dict.fromkeys(parsed(TRIAL).names) | {"nct_id": f"NCT{seq:08d}", "brief_title": "T", "brief_summary": "S", "overall_status": "completed"} | over
    return tuple(row[n] for n in parsed(TRIAL).names) + (seq,)


def trial_frame(spark, rows):
    return spark.createDataFrame(rows, parsed(TRIAL + ", seq long"))


def graded(spark, rows):
    out = quality.grade(trial_frame(spark, rows), quality.trial_gate("2026-01-01"))
    return {r.seq: (r.quality_failures, r.data_quality_flags) for r in out.collect()}


def test_every_trial_check(spark):
    got = graded(
        spark,
        [
            trial(1),
            trial(2, brief_title=" 　"),
            trial(3, brief_summary=None),
            trial(4, nct_id="NCT1"),
            trial(5, nct_id="NCT00000001"),
            trial(6, min_age_years=70.0, max_age_years=60.0),
            trial(7, enrollment=-1.0),
            trial(8, overall_status="odd"),
            trial(9, last_update="2020-12"),
            trial(10, last_update="2020-12-30"),
            trial(11, last_update="never"),
            trial(12, nct_id=None),
            trial(13, nct_id=None),
            trial(14, overall_status=None, last_update="2021-01-02"),
        ],
    )
    assert got[1] == ("", "")
    assert got[2] == ("MISSING_IDENTITY", "") and got[3] == ("", "MISSING_SUMMARY") and got[4] == ("INVALID_NCT_ID", "")
    assert got[5] == ("DUPLICATE_NCT_ID", "") and got[6] == got[7] == ("IMPOSSIBLE_NUMERIC_VALUE", "")
    assert got[8] == got[14] == ("", "UNKNOWN_STATUS_VALUE") and got[9] == got[10] == ("", "STALE_RECORD") and got[11] == ("", "")
    assert got[12][0] == "MISSING_IDENTITY|INVALID_NCT_ID" and got[13][0] == "MISSING_IDENTITY|INVALID_NCT_ID|DUPLICATE_NCT_ID"


def test_verdict_and_halt(spark):
    gate = quality.trial_gate("2026-01-01")
    ok = [trial(i) for i in range(7)]
    at_limit = quality.grade(trial_frame(spark, ok + [trial(i, nct_id="bad") for i in range(7, 10)]), gate)
    row = quality.verdict(at_limit).first()
    assert (row.evaluated, row.rejected, row.fatal_ratio, row.halt_pipeline) == (10, 3, 0.3, False)
    over = quality.grade(trial_frame(spark, ok + [trial(i, nct_id="bad") for i in range(7, 11)]), gate)
    with pytest.raises(quality.BatchHalted):
        quality.enforce(quality.verdict(over))
    empty = quality.verdict(quality.grade(trial_frame(spark, []), gate)).first()
    assert (empty.evaluated, empty.fatal_ratio, empty.halt_pipeline, empty.passed_all_gates) == (0, 0.0, False, True)


def test_split_is_a_partition(spark):
    g = quality.grade(trials(spark, SF), quality.trial_gate("2026-01-01"))
    clean, rejected = quality.clean_rows(g), quality.rejected_rows(g)
    assert clean.count() + rejected.count() == g.count()
    assert "quality_failures" not in clean.columns and "data_quality_flags" not in rejected.columns


def test_five_statuses_pass_the_gate_and_fail_conformance(spark):
    df = trial_frame(spark, [trial(1, overall_status="AVAILABLE"), trial(2, overall_status="SUSPENDED", conditions="A; ;B;")])
    assert quality.clean_rows(quality.grade(df, quality.trial_gate("2026-01-01"))).count() == 2
    checked = {r.seq: r for r in fhir.validated(df, "ResearchStudy").collect()}
    assert len(checked[1].issues) == 1 and "could not be derived" in checked[1].issues[0] and checked[2].issues == []
    assert [c.text for c in checked[2].resource.condition] == ["A", "B"] and checked[2].resource.phase.text == "N/A"


def patient_frame(spark, *rows):
    base = dict.fromkeys(parsed(PATIENT).names)
    return spark.createDataFrame([tuple((base | r)[n] for n in base) for r in rows], parsed(PATIENT))


def test_patient_conformance(spark):
    df = patient_frame(
        spark,
        {"patient_name": "Ada B Cole", "medical_record_number": "M1", "gender": "female", "date_of_birth": "1990-01", "email": "a@b.cd"},
        {"patient_name": " ", "gender": "F", "date_of_birth": "7/2/1961", "email": "nope"},
    )
    good, bad = fhir.validated(df, "Patient").collect()
    assert good.issues == [] and good.resource.name[0].family == "Cole" and good.resource.name[0].given == ["Ada", "B"]
    assert len(bad.issues) == 5 and bad.resource.name[0].family is None
    table = fhir.issue_table(fhir.validated(df, "Patient"), "medical_record_number").collect()
    assert {r.key for r in table} == {"<unknown>"} and [r.position for r in table] == list(range(5))


def test_deidentify(spark):
    df = patient_frame(
        spark,
        {"patient_name": "Ada", "medical_record_number": "MRN-1234", "diagnosis": "call 212-555-0123", "email": "a@b.cd"},
        {"patient_name": "Ada", "medical_record_number": ""},
        {"patient_name": "Bob"},
        {},
    )
    safe, findings = governance.deidentify(df, "s")
    rows = safe.collect()
    assert not set(safe.columns) & {"patient_name", "email", "medical_record_number"}
    assert rows[0].diagnosis == "call [REDACTED_PHONE]" and rows[3].patient_pseudonym is None
    assert len({r.patient_pseudonym for r in rows}) == 4
    assert {r.type: r.hits for r in governance.phi_summary(findings).collect()} == {
        "FIELD:patient_name": 3,
        "FIELD:medical_record_number": 2,
        "FIELD:email": 1,
        "PHONE": 1,
    }


def test_masking(spark):
    df = spark.createDataFrame([("N", "x", "y", "z")], "nct_id string, diagnosis string, email string, study_type string")
    row = lambda role: tuple(governance.apply_access_policy(df, role).first())
    assert row("data_engineer") == ("N", "***MASKED[INTERNAL]***", "***MASKED[RESTRICTED]***", "***MASKED[CONFIDENTIAL]***")
    assert row("treating_physician")[:3] == ("N", "x", "y") and row("nobody")[0] == "***MASKED[PUBLIC]***"
    with pytest.raises(governance.UnknownRole):
        governance.check_role("nobody")
    assert {r.field: r["class"] for r in governance.classify(df).collect()}["study_type"] == "CONFIDENTIAL"


def test_redaction_leaves_nothing_gated(spark):
    df = notes(spark, SF)
    admitted, blocked = governance.phi_gate(df)
    assert admitted.count() + blocked.count() == df.count() and blocked.count() > 0
    from evispark.functions.phi import redact_phi

    again = governance.phi_gate(blocked.withColumn("text", redact_phi(F.col("text"))))[1]
    assert again.count() == 0


def test_studies_with_missing_levels(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"protocolSection": {"identificationModule": {"nctId": "NCT00000001"}, "contactsLocationsModule": {"locations": '
        '[{"city": "A", "country": "C"}, {"city": "A", "country": "C"}, {"state": "B"}]}, "armsInterventionsModule": {"interventions": '
        '[{"name": "x"}, {"type": "DRUG", "name": "y"}]}, "eligibilityModule": {"minimumAge": "6 Months"}}}\n{}\n'
    )
    from evispark.sources.files import read_studies

    full, bare = sorted(flatten.flatten_studies(read_studies(spark, str(tmp_path / "s.json"))).collect(), key=lambda r: r.nct_id is None)
    assert full.locations == "A, C; B" and full.interventions == "OTHER: x; DRUG: y" and full.min_age_years == 0.5 and full.conditions == ""
    assert bare.nct_id is None and bare.locations == "" and flatten.with_identifier(spark.createDataFrame([bare, full], parsed(TRIAL)), "nct_id").count() == 1
    assert parsed(STUDY).names == ["protocolSection"]


def test_articles_from_files(spark, tmp_path):
    from evispark.sources.files import read_articles_xml

    one = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>T\n t</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>\n" + "\n".join(one.format(i) for i in range(5)) + "<PubmedArticle><broken></PubmedArticle></PubmedArticleSet>")
    got = flatten.flatten_articles(read_articles_xml(spark, str(tmp_path / "a.xml"))).collect()
    assert sorted(r.pmid for r in got) == list("01234") and {r.title for r in got} == {"T\n t"} and {r.abstract for r in got} == {None}


def test_trial_chunks(spark):
    long = ". ".join(f"sentence {i} of the summary" for i in range(100))
    df = trial_frame(spark, [trial(1, brief_summary=long, interventions=" ", min_age_years=18.0), trial(2, brief_summary=None)])
    got = {r.chunk_id: r for r in chunk_trials(df).collect()}
    assert "NCT00000001::interventions::0" not in got and "NCT00000002::summary::0" not in got
    first, second = got["NCT00000001::summary::0"].text, got["NCT00000001::summary::1"].text
    assert first.startswith("Trial NCT00000001 - T\nStatus: completed | Phase: N/A | Conditions: \n[SUMMARY] sentence 0")
    assert first[-150:] in second
    assert "Eligible ages: 18 to no upper limit years. Sex eligible: unspecified. Enrollment target: unspecified." in got["NCT00000001::eligibility::0"].text


def test_article_chunks(spark):
    df = spark.createDataFrame([("7", "Title", None, None, None, "", "", "", "u"), ("8", "B", "Abs", "J", 2020, "A B", "Review", "10.1/x", "u")], parsed(ARTICLE))
    got = {r.chunk_id: r.text for r in chunk_articles(df).collect()}
    assert set(got) == {"PMID7::citation::0", "PMID8::abstract::0", "PMID8::citation::0"}
    assert got["PMID7::citation::0"].startswith("Article PMID 7 - Title\nUnknown journal (n.d.) | Journal Article\n[CITATION] Unknown authors. Title.")
    assert got["PMID8::citation::0"].endswith("A B. B. J 2020. doi:10.1/x")


def test_dense_topk_does_not_depend_on_partitions(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    rows = [sorted(map(tuple, retrieval.dense_topk(q, v.repartition(n), 7, digits=6, key="vec_id").collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and len(rows[0]) == 7 * q.count()
    none = retrieval.dense_topk(q.filter("false"), v, 7, key="vec_id")
    assert none.count() == 0


def test_first_conflicting_age_counts(spark):
    rows = [("N1", "c1", "aged 19 years, at least 65 years, older than 80 yrs", 18.0), ("N2", "c2", "at least 65 years", None), ("N3", "c3", None, 18.0)]
    got = retrieval.age_conflicts(spark.createDataFrame(rows, "nct_id string, chunk_id string, text string, min_age_years double")).collect()
    assert [(r.chunk_id, r.structured_min_age, r.stated_in_text) for r in got] == [("c1", 18.0, 65.0)]
    assert got[0].message == (
        "Trial N1 declares a minimum age of 18 in its structured eligibility field, but its criteria text states 65 years. "
        "Verify against the registry before screening."
    )


def test_triad_without_contexts_is_zero(spark):
    a = spark.createDataFrame([(1, "what is it", "asthma study results"), (2, "q", "")], "query_id long, query string, answer string")
    c = spark.createDataFrame([(1, "Asthma study in adults")], "query_id long, text string")
    got = {r.query_id: r for r in answers.rag_triad(a, c).collect()}
    assert got[1].groundedness == 0.6667 and tuple(got[2])[1:] == (0.0, 0.0, 0.0)


def test_index_dimensions(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, vector array<float>")
    with pytest.raises(index.DimensionMismatch):
        index.check_dimensions(index.index_stats(df), 2)
    index.check_dimensions(index.index_stats(df.filter("chunk_id = 'a'")), 2)


def test_literature_gate(spark):
    g = quality.grade(articles(spark, SF), quality.literature_gate(2026))
    assert g.filter("pub_year = 1700 AND NOT contains(quality_failures, 'IMPOSSIBLE')").count() == 0


def test_dense_blocks_and_parts_give_what_a_broadcast_gives(spark, monkeypatch):
    rows = spark.range(900).select(F.col("id").alias("vec_id"), F.array(*[F.round(F.rand(i + 1) - 0.5, 1) for i in range(4)]).alias("vector"))
    rows = rows.unionByName(spark.createDataFrame([(1000, [0.0] * 4), (1001, [])], "vec_id long, vector array<double>")).cache()
    asked = rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(retrieval, "PART", 200)
    one, many = (sorted(tuple(r) for r in retrieval.dense_topk(asked, rows, 7, digits=3, key="vec_id", block=n).collect()) for n in (4096, 20))
    assert one == many and len(one) == 91 * 7


@pytest.mark.parametrize("spread", [0.05, 3.0])  # tight clusters, and none to speak of
def test_lists_give_what_all_vectors_give(spark, tmp_path, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    made = [(i, (centres[i % 12] + spread * rng.normal(size=6)).round(3).tolist()) for i in range(900)] + [(1000, [0.0] * 6), (1001, [0.0] * 6), (1002, [])]
    rows = spark.createDataFrame(made, "vec_id long, vector array<double>")
    asked = rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    held = lists.ListIndex.write(rows, str(tmp_path / "l"), "vec_id", lists=24)
    expected = sorted(tuple(r) for r in retrieval.dense_topk(asked, rows, 7, digits=4, key="vec_id").collect())
    for block in (4096, 40):
        got = lists.list_topk(asked, held, 7, digits=4, block=block).select("query_id", "vec_id", "dense_score", "dense_rank")
        assert sorted(tuple(r) for r in got.collect()) == expected
    q = lists.matrix([v for i, v in made if i % 10 == 0 and any(v)])
    bounds = lists.Bounds(held, q)
    scores = q @ lists.matrix([v for _, v in made if any(v)]).T
    read = bounds.reaching(np.sort(scores, axis=1)[:, -7], None).mean()
    assert read < 0.3 if spread < 1 else read > 0.3
    assert lists.list_topk(asked.filter("false"), held, 7).count() == 0


def test_sparse_join_gives_what_a_broadcast_gives(spark):
    words = "ada bab cac dad eae faf the the the".split()
    texts = [(i, " ".join(words[(i * k) % 9] for k in range(1, 2 + i % 12)) + " rare" * (i % 30 == 0)) for i in range(300)] + [(300, None), (301, "")]
    posted = index.postings(spark.createDataFrame(texts, "chunk_id long, text string")).cache()
    stats = index.posted_stats(posted)
    terms = retrieval.query_terms(spark.createDataFrame([(1, "the the bab"), (2, "rare zzz"), (3, "???")], "query_id long, query string"))
    idf = index.term_stats(posted, stats.select("n"))
    one, many = (sorted(tuple(r) for r in retrieval.sparse_topk(terms, posted, idf, stats, 7, most=n).collect()) for n in (1000, 1))
    assert one == many and len(one) == 14
    assert retrieval.sparse_topk(terms, posted.limit(0), idf, stats, 7).count() == 0


def test_overlap(spark):
    text = "\n\n".join(f"part {i} " + "word " * 60 for i in range(5))
    got = spark.createDataFrame([(text,), ("short",), (None,), ("",)], "t string").select(split_text(F.col("t"), 400).alias("p"))
    got = got.select(with_overlap("p", 20).alias("p")).collect()
    plain = split_pieces(text, 400)
    assert got[0].p == plain[:1] + [f"{a[-20:]} {b}".strip() for a, b in zip(plain, plain[1:], strict=False)] and len(plain) == 5
    assert [r.p for r in got[1:]] == [["short"], None, [""]]


def test_a_chunk_is_not_added_twice(spark, tmp_path):
    store = index.ChunkStore(spark, str(tmp_path / "i"), buckets=3)
    frame = lambda *rows: spark.createDataFrame(rows, "chunk_id string, n int")
    with pytest.raises(index.DuplicateChunks, match="'a'"):
        store.write(frame(("a", 1), ("a", 1), ("b", 2)))
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.write(frame(("a", 1), ("b", 2))).count() == 2
    for clash in (frame(("b", 3), ("c", 3)), frame(("d", 3), ("d", 4))):
        with pytest.raises(index.DuplicateChunks):
            store.write(clash)
    assert store.write(frame(("c", 3))).count() == store.read().count() == 3
    with pytest.raises(index.DuplicateChunks):
        store.write(frame(("x", 1), ("x", 1)), reset=True)
    assert store.read().count() == 3
    other = index.ChunkStore(spark, str(tmp_path / "i"), buckets=5)  # buckets change with a reset alone
    other.write(frame(("d", 3)))
    assert other.write(frame(("x", 1)), reset=True).count() == store.read().count() == 1
    spark.sql(f"DROP TABLE {store._name(1)}")  # as in a new session
    assert index.ChunkStore(spark, str(tmp_path / "i")).read().first().chunk_id == "x"


def test_records_without_id_have_keys_of_their_own(spark):
    rows = [trial(1, nct_id=None), trial(2, nct_id=None, brief_summary="other"), trial(3, nct_id=None), trial(4)]
    ids = sorted(r.chunk_id for r in chunk_trials(trial_frame(spark, rows)).filter("section = 'summary'").collect())
    assert ids[0] == "NCT00000004::summary::0" and all(i.startswith("UNNAMED-") for i in ids[1:]) and len(set(ids)) == 3  # two are alike in all


def test_scores_are_pruned_without_loss(spark, monkeypatch):
    """Every question has a word that all chunks have; blocks of eight chunks, each question against brute force."""
    import math
    import random

    rng = random.Random(6)
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "PART", 300)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(600)]
    texts = {i: ["all", *(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))] for i in range(900)}
    asked = {q: ["all", *(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5)))] for q in range(120)}
    posted = index.postings(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "chunk_id long, text string").repartition(3)).cache()
    stats = index.posted_stats(posted)
    idf = index.term_stats(posted, stats.select("n"))
    weight, mean = {r.term: r.idf for r in idf.collect()}, sum(map(len, texts.values())) / len(texts)
    expected = []
    for q, words in asked.items():
        scores = []
        for i, w in texts.items():
            parts = [weight[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in words if t in w]
            if round(math.fsum(parts), 6) > 0:
                scores.append((-round(math.fsum(parts), 6), i))
        expected += [(q, i, rank, -s) for rank, (s, i) in enumerate(sorted(scores)[:7], 1)]
    terms = retrieval.query_terms(spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id long, query string"))
    for most in (10_000, 1, 60):
        got = retrieval.sparse_topk(terms, posted, idf, stats, 7, most=most)
        assert "term" not in " ".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
        assert sorted((r.query_id, r.chunk_id, r.sparse_rank, r.sparse_score) for r in got.collect()) == sorted(expected)
    scorer = retrieval._Scorer([1, 2], ["all", "rare"], [0.1, 5.0], (5.0, 3, 1.5, 0.75, 6, "chunk_id"))
    scored = []
    monkeypatch.setattr(retrieval._Scorer, "_score", lambda self, *a, f=retrieval._Scorer._score: (scored.append(len(a[-1])), f(self, *a))[1])
    table = index.postings(spark.createDataFrame([(i, "all rare" if i < 3 else "all " * (1 + i % 3)) for i in range(400)], "chunk_id long, text string").coalesce(1)).toArrow()
    scorer.add(table.combine_chunks().to_batches()[0])
    assert sum(scored) < 60  # of 100 pairs of block and question


def plain_chunks(record, header, sections):
    out = []
    record = record or "UNNAMED-" + hashlib.md5("\x1f".join([header, *(b or "" for b in sections.values())]).encode()).hexdigest()[:20]
    for name, body in sections.items():
        pieces = split_pieces(body, 900) if (body or "").strip() else []
        pieces = pieces[:1] + [f"{a[-150:]} {b}".strip() for a, b in zip(pieces, pieces[1:], strict=False)]
        out += [(f"{record}::{name}::{i}", name, i, f"{header}[{name.upper()}] {x}".strip()) for i, x in enumerate(pieces)]
    return out


def test_every_chunk_of_both_sources(spark):
    """All chunks of whole tables against plain Python."""
    number = lambda v, absent: absent if v is None else f"{v:g}"
    expected = []
    for t in trials(spark, SF).collect():
        header = f"Trial {t.nct_id or ''} - {t.brief_title or ''}\nStatus: {t.overall_status or ''} | Phase: {t.phase or 'N/A'} | Conditions: {t.conditions}\n"
        facts = f"Eligible ages: {number(t.min_age_years, 'unspecified')} to {number(t.max_age_years, 'no upper limit')} years. Sex eligible: {t.sex or 'unspecified'}. "
        facts += f"Enrollment target: {number(t.enrollment, 'unspecified')}.\n"
        expected += plain_chunks(t.nct_id, header, {"summary": t.brief_summary, "eligibility": facts + t.eligibility_criteria, "interventions": t.interventions})
    got = queries.chunk_trials(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(got) > 600
    expected = []
    for a in articles(spark, SF).collect():
        header = f"Article PMID {a.pmid or ''} - {a.title or ''}\n{a.journal or 'Unknown journal'} ({a.pub_year or 'n.d.'}) | {a.publication_types or 'Journal Article'}\n"
        citation = f"{a.authors or 'Unknown authors'}. {a.title or ''}. {a.journal or ''} {a.pub_year or ''}. doi:{a.doi or 'n/a'}"
        expected += plain_chunks(a.pmid and f"PMID{a.pmid}", header, {"abstract": a.abstract, "citation": citation})
    got = queries.chunk_articles(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(got) > 400
    counted = {r.source_type: r.chunks for r in queries.chunk_counts(spark, SF).collect()}
    assert counted["literature"] >= len(got)


def test_lexical_rerank_of_odd_questions(spark):
    asked = spark.createDataFrame([("q1", "Asthma dose asthma"), ("q2", "?!"), ("q3", None)], "query_id string, query string")
    hits = spark.createDataFrame(
        [("q1", "c1", "dose of ASTHMA"), ("q1", "c2", "dose"), ("q1", "c3", None), ("q2", "c1", "dose"), ("q3", "c1", "dose")],
        "query_id string, chunk_id string, text string",
    )
    weights = spark.createDataFrame([("asthma", 3.0)], "term string, weight double")  # dose weighs 1
    got = {(r.query_id, r.chunk_id): r.rerank_score for r in retrieval.lexical_rerank(hits, asked, weights).collect()}
    assert got == {("q1", "c1"): 1.0, ("q1", "c2"): 0.25, ("q1", "c3"): 0.0, ("q2", "c1"): 0.0, ("q3", "c1"): 0.0}


def test_a_fragment_is_parsed_once(spark):
    """Filters for what is an article don't call the parser again below a projection."""
    for df in (flatten.flatten_articles(queries.article_xml(spark, SF)), flatten.unread_articles(queries.article_xml(spark, SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1


def test_slices_hold_little(spark):
    sizes = np.array([3, 0, 5, 100, 1, 1, 1, 0])
    cut = list(vectors.slices(sizes, rows=3, size=8))
    assert cut == [(0, 3), (3, 4), (4, 7), (7, 8)] and list(vectors.slices(np.array([], int))) == []
    texts = ["a b", None, "", "x " * 3000, "\u0130K \u00e9b", "q\x00r\x1cs"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = [r.v for r in df.select("i", vectors.hash_embed(F.col("t")).alias("v")).orderBy("i").collect()]
    assert np.array_equal(np.array(got, np.float32), vectors.hash_vectors(texts))


@pytest.mark.parametrize("text", ["x mrn-12AB", "n 123-45-6789.", "1234567890", "a 21234567890", "a.b@c.de", "at 5 North Market Road", "at 5 North Roadé", "5 Ab St", "", "Status - 2020 @"])
def test_cheap_needs_of_gated_families_lose_no_hit(spark, text):
    row = spark.createDataFrame([(text,)], "t string")
    whole = [F.col("t").rlike(f"(?U){policy.PHI_PATTERNS[f]}") for f in policy.GATED_FAMILIES]
    assert row.select(phi.is_gated(F.col("t")) == F.greatest(*whole)).first()[0]


def test_numbered_rows_are_graded_where_they_stand(spark, tmp_path, monkeypatch):
    """As rows without numbers, and whole rows are not shuffled, however many keys come again."""
    keys = [None if i % 31 == 0 else f"NCT{i % 150:08d}" for i in range(400)]
    trial_frame(spark, [trial(i // 2, nct_id=k) for i, k in enumerate(keys)]).repartition(3).withColumn("_number", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/t")
    held = spark.read.parquet(f"{tmp_path}/t")
    ever = held.groupBy(F.col("nct_id").alias("_key")).agg((F.count("*") + F.max(F.col("seq") % 2)).alias("_ever"))
    gate, before = quality.trial_gate("2026-01-01"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for history in (None, ever):
        want = sorted(map(str, quality.grade(held.drop("_number"), gate, ever=history).collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were more keys than Spark broadcasts
        try:
            got = quality.grade(held, gate, ever=history, number="_number")
            assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Exchange hash" not in plan
            assert sorted(map(str, got.collect())) == want
            monkeypatch.setattr(quality, "MARKED", 0)  # too many to broadcast
            assert sorted(map(str, quality.grade(held, gate, ever=history, number="_number").collect())) == want
        finally:
            monkeypatch.undo()
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
