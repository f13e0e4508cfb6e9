"""Parsers and counts against Python's own regular expressions, quirks included."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordinalis.functions import text as T
from ordinalis.operators.features import text_features

# The first four are the original's own cases, kept as they are because they define the parser; the others are ours.
AGES = [
    ("2 month old kitten", 2.0), ("He is 1 year old", 12.0), ("dua bulan", 2.0), ("rescued 2 years ago, now 4 months", 4.0),
    ("2 and a half years", 24.0), ("half year", 6.0), ("extra months", 1.0), ("bone years", 12.0), ("1-2 months", 2.0),
    ("2.5 months", 2.5), ("21 years", None), ("3 Weeks+ and 1.5 yrs", 3 * 12 / 52), ("", None), (None, None), ("６ months", 6.0),
]
COUNTS = [("mama kittens", 1.0), ("extra puppies", 1.0), ("three small kittens", 3.0), ("12 puppies", 12.0), ("40 cats", None), (None, None)]


@pytest.mark.parametrize(("fn", "cases"), [(T.age_months, AGES), (T.pet_count, COUNTS)])
def test_parsers(spark, fn, cases):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.v for r in rows.select("k", fn(T.matchable("t")).alias("v")).collect()}
    for k, (text, want) in enumerate(cases):
        assert got[k] == (pytest.approx(want) if want is not None else None), text


def test_features_match_python(spark):
    texts = [None, "", "   ", "Two CATS! 3 pups?", "É ÀB velvet blame 12\xa0months", "它很活泼2只 kitten", "சுறு cat. dan yang", "a\tb\nc  d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in text_features(rows, "k", "t").collect():
        t = texts[r.k] or ""
        low = t.lower()
        assert (r.desc_len, r.desc_words, r.desc_excl) == (len(t), len(t.split()), t.count("!"))
        assert r.desc_digits == len(re.findall(r"\d", t)) and r.desc_is_empty == int(t.strip() == "")
        assert r.desc_upper_ratio == pytest.approx(sum(c.isupper() for c in t) / max(len(t), 1))
        assert r.n_sentences == len(re.findall(r"[.!?]+", t)) + 1 and r.malay_words == len(re.findall(T.MALAY, low))
        for name, pattern in T.KEYWORDS.items():
            assert r[name] == len(re.findall(pattern, low)), (name, t)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab 1!?.É中\xa0\n", max_size=30), min_size=1, max_size=8))
def test_normalized_property(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in rows.select("k", T.normalized("t").alias("n"), F.length("t").alias("l")).collect():
        assert r.n == re.sub(r"\s+", " ", texts[r.k].lower()).strip() and r.l == len(texts[r.k])
