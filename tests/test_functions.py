import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.extraction import sentences_of


def one(spark, expr, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'binary' if isinstance(v, bytes) else 'double'}" for i, v in enumerate(values))).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("given", "core", "key"), [
    ("https://arxiv.org/abs/2205.09329v2", "2205.09329", "2205.09329v2"), ("2205.09329", "2205.09329", "2205.09329v1"), ("http://arxiv.org/pdf/2101.00001v3.pdf", "2101.00001", "2101.00001v3"),
    ("hep-th/9901001v3", "hep-th/9901001", "hep-th/9901001v3"), (" arxiv.org/abs/2101.00001 ", "2101.00001", "2101.00001v1"), ("2101.00001V4", "2101.00001", "2101.00001v4"),
])
def test_ids(spark, given, core, key):
    assert one(spark, T.id_core("c0"), given) == core and one(spark, T.paper_key("c0"), given) == key


@pytest.mark.parametrize(("given", "want", "number"), [(None, "v1", 1), ("", "v1", 1), (" 3 ", "v3", 3), ("V7", "v7", 7), ("draft", "draft", 0)])
def test_versions(spark, given, want, number):
    assert one(spark, T.format_version("c0"), given) == want and one(spark, T.version_number("c0"), given) == number


@pytest.mark.parametrize(("given", "want"), [("3.2 Experiments & Results", "results"), ("Appendix A", "other"), ("ABSTRACT", "always"), ("Our Proposed Model", "method"), ("Related Work", "related"), ("Future work", "limits"), ("References", "biblio"), ("", "other")])
def test_headings(spark, given, want):
    assert one(spark, T.heading_kind("c0"), given) == want


def test_normalize(spark):
    assert one(spark, T.normalize_text("c0"), "  a so­ft exam-\n ple\tof   text ") == "a soft example of text"
    assert one(spark, T.headings_match("c0", "c1"), "2. Methods", "Methods and Models") and not one(spark, T.headings_match("c0", "c1"), "", "x")


def fold(text):
    text = re.sub(r"\s+", " ", re.sub(r"(\w)-\s+(\w)", r"\1\2", text.replace("­", ""))).strip()
    out = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text):
        if 40 <= len(s) <= 600 or (20 <= len(s) < 40 and not out):
            out.append(s)
        elif 20 <= len(s) < 40:
            out[-1] += " " + s
    return out


def test_sentences_equal_a_plain_fold(spark):
    texts = ["", "Short.", "This one has twenty chars. " * 5, "A" * 700 + ". Then a sentence that is long enough to stay here alone. Tiny. And one of middle size here.", "é" * 45 + "! 3 more words follow in this sentence of good length? Yes."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sentences_of("t").alias("s")).collect()
    assert [r.s for r in rows] == [fold(r.t) for r in rows]


def test_sniff(spark):
    for data, want in [(b"%PDF-1.5", "pdf"), (b"\x1f\x8b\x08", "gzip"), (b"<!DOCTYPE html>", "html"), (b"x <HTML> y", "html"), (b"\\documentclass{a}", "tex"), (b"", "unknown"), (b"\0" * 257 + b"ustar", "tar"), (b"plain", "unknown")]:
        assert one(spark, T.sniff("c0"), data) == want


def test_dates_numbers_and_secrets(spark):
    assert one(spark, T.year_of("c0", "c1"), "Mon, 2 Apr 2007 19:18:42 GMT", "0704.0001") == 2007
    assert one(spark, T.year_of("c0", "c1"), None, "9912.0001") == 1999 and one(spark, T.year_of("c0", "c1"), "bad", "2104.0001") == 2021
    assert one(spark, T.lenient_int("c0"), "2020.0") in (None, 2020) and one(spark, T.lenient_int("c0"), 2020.9) == 2020 and one(spark, T.lenient_int("c0"), "x") is None
    assert one(spark, T.redact("c0", ["abcd", "ab"]), "k=abcd ab") == "k=[redacted] ab"
    assert one(spark, T.estimate_tokens("c0"), "é") == 66
    assert one(spark, T.grounding_confidence(F.lit(True), F.lit(False), F.lit(4), F.lit(3)), "x") == 0.838
