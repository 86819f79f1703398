"""Label functions against the values of FIXTURES.md and plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T

L = {"athlete": ["ath", "hle", "e  ", "ete"], "red plate": ["red", "e  ", "d p", "  r"], "a": ["  a", " a ", "a  "], "new york city": ["ity", "yor", " ci", "cit"]}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize(("given", "want"), [("Athlete", "athlete"), ("  STRASSE\t ß ", "strasse ss"), ("ﬁne ΣΑΣ", "fine σασ"), ("a\x1cb", "a b"), ("İ", "i̇"), ("", ""), ("\x85  ", "")])
def test_normal_form(spark, given, want):
    assert T.normal_form(given) == want
    assert spark.createDataFrame([(given,)], "x string").select(T.normalize_label(F.col("x"))).first()[0] == want


def test_normal_form_of_null(spark):
    assert spark.createDataFrame([(None,)], "x string").select(T.normalize_label(F.col("x"))).first()[0] is None


def test_anchors_in_hash_order(spark):
    rows = spark.createDataFrame([(x,) for x in L], "x string").select("x", T.anchor_grams(F.col("x"), 4).alias("g")).collect()
    assert {r["x"]: r["g"] for r in rows} == L


def test_trigram_counts(spark):
    rows = spark.createDataFrame([(x,) for x in L], "x string").select("x", F.size(T.trigrams(F.col("x"))).alias("n")).collect()
    assert {r["x"]: r["n"] for r in rows} == {"athlete": 9, "red plate": 11, "a": 3, "new york city": 15}


PAIRS = [
    ("athlete", "athletes", 0.736842, 0.933333, 0.933333), ("new york city", "york new city", 0.8, 0.692308, 1.0), ("football player", "footbal player", 0.909091, 0.965517, 0.965517),
    ("river", "rivers", 0.666667, 0.909091, 0.909091), ("berlin", "berlin city", 0.666667, 0.705882, 0.705882), ("politician", "physician", 0.521739, 0.631579, 0.631579), ("a", "b", 0.0, 0.0, 0.0),
]


def test_scores(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "x string, y string")
    x, y = F.col("x"), F.col("y")
    rows = df.select(T.trigram_dice(T.trigrams(x), T.trigrams(y)), T.indel_ratio(x, y), T.final_similarity(x, y), T.similarity(x, y)).collect()
    for got, want in zip(rows, PAIRS, strict=True):
        assert [round(v, 6) for v in got] == [*want[2:], want[4]]


def test_length_ratio_is_binary(spark):
    # 0.9 * 0.8 is a little above 0.72, so 18 of 25 is not enough
    df = spark.createDataFrame([("x" * 18, "y" * 25), ("", "y"), ("x" * 19, "y" * 25)], "x string, y string")
    assert [r[0] for r in df.select(T.length_possible(F.col("x"), F.col("y"), 0.9)).collect()] == [False, False, True]


def test_score_text_rounds_half_to_even(spark):
    values = [0.0078125, 0.0390625, 0.9333333333, 1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(T.score_text(F.col("v"))).collect()]
    assert got == [f"{v:.6f}" for v in values]


def test_ids(spark):
    row = spark.range(1).select(T.pair_id(F.lit(1), F.lit("http://l/A"), F.lit("http://r/B")), T.file_name(F.lit("http://l/A"))).first()
    assert list(row) == ["000001_7ba6c2775e52ee450f6d", "c78bbb3e904724482535746cfc32b891169ab64939b2cb1d0653de025cdb024a.csv"]


def test_iris(spark):
    good, bad = ["http://a/b", "HTTPS://a"], ["ftp://a", "http:///x", "http://a b", "http://a/<", "http://a/\x01", "a", "", "http://a/`"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select(T.is_iri(F.col("x"))).collect()
    assert [r[0] for r in rows] == [True] * len(good) + [False] * len(bad)
    with pytest.raises(Exception, match="invalid IRI"):
        spark.createDataFrame([("x",)], "x string").select(T.iri_term(F.col("x"))).collect()


@settings(max_examples=200, deadline=None)
@given(st.text("abc é😀", max_size=30), st.text("abc é😀", max_size=30))
def test_lcs(a, b):
    assert T.lcs_length(a, b) == plain_lcs(a, b) == T.lcs_length(b, a)
    assert 0 <= T.ratio(a, b) == T.ratio(b, a) <= 1


def test_long_lcs():
    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcd", k=300)) for _ in range(2))
    assert T.lcs_length(a, b) == plain_lcs(a, b)
