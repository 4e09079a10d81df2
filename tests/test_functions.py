import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.functions.phi import found_families, is_gated, redact_phi, scan_phi
from evispark.functions.splitting import SEPARATORS, split_pieces, with_overlap
from evispark.functions.text import blank, exploded, number_text, parse_age_years, pseudonymise, strip
from evispark.functions.vectors import hash_vectors
from evispark.functions.xml import parse_article


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).coalesce(1).select(column).collect()]


def test_ages(spark):
    got = values(spark, ["18 Years", "6 Months", "10 weeks", "1.5 Months", " 3 days", "N/A", "x 5 years", None, ""], parse_age_years(F.col("v")))
    assert got == [18.0, 0.5, 0.19, 0.12, 0.01, None, None, None, None]


def test_numbers(spark):
    rows = [18.0, 0.5, 1234567.0, 100000.0, 0.00001, -3.25, 123456.7, 0.0, None, float("nan")]
    expected = ["18", "0.5", "1.23457e+06", "100000", "1e-05", "-3.25", "123457", "0", "none", "none"]
    assert values(spark, rows, number_text(F.col("v"), "none"), "v double") == expected
    assert expected[:8] == [f"{x:g}" for x in rows[:8]]


def test_white_space(spark):
    assert values(spark, ["　 a b \t", None], strip(F.col("v"))) == ["a b", None]
    assert values(spark, ["　", "", None, "x"], blank(F.col("v"))) == [True, True, True, False]


def test_pseudonyms(spark):
    a, b, c = values(spark, ["MRN-1", "MRN-1", None], pseudonymise(F.col("v"), "salt"))
    assert a == b and a.startswith("PATIENT_") and len(a) == 18 and c is None


def test_phone_takes_registry_ids_unless_they_are_protected(spark):
    texts = ["see NCT04223752 now", "NCT04223752", "born 1958-03-14", "call +44-20-555-1234 re NCT04223752 MRN-12345", None, ""]
    assert values(spark, texts, redact_phi(F.col("v"))) == [
        "see NCT[REDACTED_PHONE] now",
        "NCT[REDACTED_PHONE]",
        "born [REDACTED_PHONE]",
        "call [REDACTED_PHONE] re NCT[REDACTED_PHONE] [REDACTED_MRN]",
        None,
        "",
    ]
    kept = values(spark, texts, redact_phi(F.col("v"), protect_ids=True))
    assert kept[:2] == texts[:2] and kept[3] == "call [REDACTED_PHONE] re NCT04223752 [REDACTED_MRN]" and kept[4:] == [None, ""]


def test_scan_and_gate(spark):
    text = "MRN-12345, a.b@clinic.example, 123-45-6789"
    (hits,) = values(spark, [text], scan_phi(F.col("v")))
    assert {"MRN", "EMAIL", "SSN"} <= {h["type"] for h in hits}
    assert values(spark, [text, "call 212-555-0123", None], is_gated(F.col("v"))) == [True, False, False]
    assert values(spark, ["call 212-555-0123", None], found_families(F.col("v")))[0] == ["PHONE"]


def test_digits_of_other_scripts_alone_are_identifiers(spark):
    """No text has an ASCII digit, an @ or the letters MRN."""
    ssn = ["".join(chr(zero + int(c)) if c.isdigit() else c for c in "123-45-6789") for zero in (0x660, 0x966, 0xFF10)]
    texts = [f"id {x} end" for x in ssn] + ["lives at ४२ Oak Street now", "call ٢١٢-٥٥٥-٠١٢٣"]
    types = [{h["type"] for h in hits} for hits in values(spark, texts, scan_phi(F.col("v")))]
    assert all("SSN" in t for t in types[:3]) and "STREET_ADDRESS" in types[3] and types[4] == {"PHONE"}
    assert values(spark, texts, is_gated(F.col("v"))) == [True] * 4 + [False]
    for keep in (False, True):
        redacted = values(spark, texts, redact_phi(F.col("v"), protect_ids=keep))
        assert redacted[:3] == ["id [REDACTED_SSN] end"] * 3
        assert redacted[3:] == ["lives at [REDACTED_STREET_ADDRESS] now", "call [REDACTED_PHONE]"]


def reference_split(text, size, depth=0):
    """An independent model: cut at the separator, join while it fits, go deeper for what doesn't."""
    if len(text) <= size or depth == len(SEPARATORS):
        return [text]
    out, held = [], ""
    for part in text.split(SEPARATORS[depth]):
        joined = held + SEPARATORS[depth] + part if held else part
        if len(joined) > size:
            out += [held] if held else []
            joined = part
        held = joined
    out += [held] if held else []
    return [q for p in out for q in reference_split(p, size, depth + 1)]


def test_splitting_matches_a_model():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choices(["a", "bb", "ccc.", " ", ". ", "\n", "\n\n"], k=rng.randint(0, 120)))
        size = rng.choice([5, 20, 60])
        pieces = split_pieces(text, size)
        assert pieces == reference_split(text, size)
        assert "".join("".join(pieces).split()).replace(".", "") == "".join(text.split()).replace(".", "")


def test_overlap(spark):
    df = spark.createDataFrame([(["abcdef", "gh", "ij"],), (["a"],), ([],), (None,)], "p array<string>")
    assert [r.p for r in df.select(with_overlap("p", 3).alias("p")).collect()] == [["abcdef", "def gh", "gh ij"], ["a"], [], None]
    assert [r.p for r in df.select(with_overlap("p", 0).alias("p")).collect()] == [r.p for r in df.collect()]


def test_hash_vectors_have_length_one_or_none():
    v = hash_vectors(["the cat and the hat", "", None, "!!"])
    assert v.shape == (4, 384) and v.dtype == np.float32
    assert np.linalg.norm(v, axis=1) == pytest.approx([1, 0, 0, 0], abs=1e-6)


def test_xml_is_parsed_with_care():
    assert parse_article("<!DOCTYPE x><PubmedArticle/>") is None
    assert parse_article("<?xml version='1.0'?>\n<!-- a > b -->\n<!DOCTYPE x [<!ENTITY e 'y'>]><PubmedArticle/>") is None
    assert parse_article("<PubmedArticle><ArticleTitle><![CDATA[<!DOCTYPE x>]]></ArticleTitle></PubmedArticle>") is not None
    assert parse_article("<PubmedArticle>") is None and parse_article(None) is None
    article = (
        "<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>q <i>w</i> &amp; e</ArticleTitle><Abstract>"
        "<AbstractText Label='AIM'>a <b>b</b> c</AbstractText><AbstractText> </AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    )
    got = parse_article(article)
    assert got["title"] == "q w & e" and got["sections"] == [{"label": "AIM", "body": "a b c"}] and got["ids"] == []


def test_a_very_long_article_is_parsed(spark):
    from evispark.operators.flatten import flatten_articles

    body = "word &amp; " * 550_000
    one = f"<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Abstract><AbstractText>{body}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    got = flatten_articles(spark.createDataFrame([(one,)], "xml string")).select("pmid", F.length("abstract")).collect()
    assert len(one) > 5_000_000 and [tuple(r) for r in got] == [("1", len("word & ") * 550_000 - 1)]


def test_exploded_arrays_are_computed_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "k int, t string")
    rows = exploded(df, F.split("t", " "), "pos", "w")
    assert sorted((r.k, r.pos, r.w) for r in rows.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert exploded(df.filter("k = 2"), F.split("t", " "), "w").count() == 0
