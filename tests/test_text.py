"""Normalisation, checksum, span scan, possessives: hand-written expectations."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import checksum, metrics, textnorm
from palimpsest.functions.spanscan import checked, scan
from palimpsest.operators.detectors import any_of, trim_possessive
from palimpsest.schema import SPANS


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("plain text", "plain text"),
        ("９８７", "987"),
        ("ﬁle", "file"),
        ("a​b﻿c", "abc"),
        ("a‌b‍c", "a‌b‍c"),
        ("a \t  b", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\n\n \nb", "a\n\n \nb"),
        ("　 a b\x1c", "a b"),
        ("", ""),
        (" \t ", ""),
    ],
)
def test_normalise(one, text, expected):
    assert one(textnorm.normalise, text) == expected


def test_normalise_null(one):
    assert one(textnorm.normalise, None) is None


def test_strip_is_pythons(one):
    for text in ("\x1c\x1d a \x1e\x1f", " a ", "\x85a\x85", "a", "\n", "a b"):
        assert one(textnorm.strip, text) == text.strip()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=40))
def test_normalise_against_python(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] or [""]

    def expected(t):
        t = unicodedata.normalize("NFKC", t).replace("​", "").replace("﻿", "")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", textnorm.normalise(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == dict(enumerate(map(expected, texts)))


def test_verhoeff(one):
    assert one(checksum.verhoeff_digit, "236") == "3"
    assert one(checksum.verhoeff_valid, "2363") is True
    assert one(checksum.verhoeff_valid, "2364") is False
    for bad in ("", "12a", "2363 "):
        assert one(checksum.verhoeff_valid, bad) is False
    assert one(checksum.verhoeff_valid, None) is None
    assert one(checksum.verhoeff_valid, "२३६३") is True
    with pytest.raises(Exception, match="all digits"):
        one(checksum.verhoeff_digit, "12a")


def test_synthetic_numbers(one):
    whole = one(checksum.with_check_digit, "31415926535")
    assert len(whole) == 12 and one(checksum.verhoeff_valid, whole)
    assert one(checksum.verhoeff_valid, one(checksum.corrupted, whole)) is False
    assert one(checksum.grouped, "123456789012") == "1234 5678 9012"
    assert one(checksum.digits_only, "12 34-5 6") == "123456"


def test_scan_is_finditer(spark):
    texts = ["a1b22", "😀12 x 3", "", "none", "1", "12 34\n56", "é1é2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", scan(F.col("t"), r"(?U)\d+", F.lit(True), "PHONE", 0.5, "d").alias("s")).collect()
    for r in rows:
        assert [(s["start"], s["end"], s["text"]) for s in r["s"]] == [(*m.span(), m[0]) for m in re.finditer(r"\d+", r["t"])]


def test_span_invariants(spark):
    good, bad = ("EMAIL", 0, 1, "x", 0.5, "d"), ("EMAIL", 3, 3, "x", 0.5, "d")
    frame = lambda s: spark.createDataFrame([([s],)], f"s {SPANS.simpleString()}")
    assert frame(good).select(checked(F.col("s"))).count() == 1
    with pytest.raises(Exception, match="breaks"):
        frame(bad).select(checked(F.col("s"))).collect()


@pytest.mark.parametrize(
    ("span", "expected"), [("Asha Rao's", "Asha Rao"), ("Asha Rao’s", "Asha Rao"), ("James'", "James"), ("Travis", "Travis"), ("'s", "'s"), ("'", "'"), ("A’", "A"), ("x's's", "x's"), ("line\n's", "line\n")]
)
def test_possessives(one, span, expected):
    assert one(trim_possessive, span) == expected


def test_metrics(spark):
    rows = spark.createDataFrame([(2, 1, 1), (0, 0, 0), (0, 1, 0), (0, 1, 1)], "tp long, fp long, fn long")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = [tuple(r) for r in rows.select(metrics.precision(tp, fp), metrics.recall(tp, fn), metrics.f1(tp, fp, fn), metrics.shown(metrics.recall(tp, fn))).collect()]
    assert out[0][:3] == (2 / 3, 2 / 3, 2 / 3) and out[1] == (None, None, None, "-") and out[2][:3] == (0.0, None, None) and out[3] == (0.0, 0.0, None, "0.000")


def test_any_of():
    pattern = re.compile(any_of(["Anna", "Ann", "Bo", "A.b"]))
    assert [m[0] for m in pattern.finditer("Anna Ann Bo A.b Axb")] == ["Anna", "Ann", "Bo", "A.b"]
    assert not re.search(any_of([]), "x")
