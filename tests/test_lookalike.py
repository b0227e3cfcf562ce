import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions.lookalike import fold, fold_text, printed_as

ALIKE = [
    ("Âge", "Âge"),
    ("３ kg", "3​ kg"),
    ("a­b", "ab"),
    ("a b", "a　b"),
    ("Ａ", "A"),
    ("ﬁn", "fin"),
    ("", "​﻿"),
    ("аео", "aeo"),
    ("μg", "µg"),
    ("е́", "é"),
]
DIFFERENT = [("10³", "103"), ("m²", "m2"), ("a", "A"), ("a  b", "a b"), ("a-b", "a–b"), ("1·5", "1.5"), ("a", "ä"), ("ab", "a b")]


@pytest.mark.parametrize(("a", "b", "same"), [(a, b, True) for a, b in ALIKE] + [(a, b, False) for a, b in DIFFERENT])
def test_python_fold(a, b, same):
    assert (fold_text(a) == fold_text(b)) is same


def test_sql_fold_and_collation_agree_with_python(spark):
    rows = [(a, b, same) for same, pairs in ((True, ALIKE), (False, DIFFERENT)) for a, b in pairs]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    out = df.select("a", "b", "same", (printed_as(F.col("a")) == printed_as(F.col("b"))).alias("eq"), fold(F.col("a")).alias("f")).collect()
    assert [r for r in out if r.eq != r.same] == []
    assert [r for r in out if unicodedata.normalize("NFC", r.f) != fold_text(r.a)] == []


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "a string")
    assert [r[0] for r in df.select(fold(F.col("a"))).collect()] == [None, ""]


@settings(max_examples=200)
@given(st.text())
def test_fold_is_stable(text):
    assert fold_text(fold_text(text)) == fold_text(text)
