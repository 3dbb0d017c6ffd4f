import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import split


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    (" a\t", "a"), ("　b​", "b​"), ("  x  y \n", "x  y"), ("", ""),
])
def test_py_strip(spark, raw, want):
    assert one(spark, T.py_strip, raw) == want == raw.strip()


@pytest.mark.parametrize("raw,want", [
    ("foo .", "foo "), ("foo?!.", "foo"), ("...", ""), ("  Brand#2?! ", "brand#2"), ("A.b", "a.b"),
])
def test_normalize_text(spark, raw, want):
    assert one(spark, T.normalize_text, raw) == want == raw.strip().lower().rstrip(".,;!?")


def test_char_length_code_points(spark):
    assert one(spark, T.char_length, "\U0001F600a") == 2


@pytest.mark.parametrize("raw,want", [
    ("1", 1.0), ("1,000", None), (" 2 ", 2.0), ("1e3", 1000.0), ("x", None), ("nan", None), (None, None),
])
def test_numeric_coerce(spark, raw, want):
    assert one(spark, T.numeric_coerce, raw) == want


def test_numeric_coerce_inf(spark):
    assert one(spark, T.numeric_coerce, "inf") == float("inf")


@pytest.mark.parametrize("v,want", [
    (-1.0, None), (-0.5, 1), (0.0, 1), (1.0, 1), (100.0, 1), (100.5, 2), (1000.0, 2),
    (1000.5, 3), (10000.0, 3), (100000.0, 4), (100001.0, 5), (None, None), (float("inf"), 5),
])
def test_volume_bucket_edges(spark, v, want):
    assert one(spark, split.volume_bucket, v, "double") == want


@pytest.mark.parametrize("raw,want", [
    ('﻿"#"', "#"), ('  "Keyword" ', "Keyword"), ('"', '"'), ("a\x00b", "ab"),
])
def test_unquote(spark, raw, want):
    assert one(spark, T.unquote, raw) == want


@pytest.mark.parametrize("path,stem,ext", [
    ("/a/b/x_cands.csv", "/a/b/x_cands", ".csv"), ("a.tar.gz", "a.tar", ".gz"),
    (".bashrc", ".bashrc", ""), ("dir.x/file", "dir.x/file", ""), ("a..b", "a.", ".b"),
])
def test_stem_ext_matches_splitext(spark, path, stem, ext):
    import os
    r = spark.createDataFrame([(path,)], "p string").select(T.stem_ext("p").alias("r")).first()["r"]
    assert (r["stem"], r["ext"]) == (stem, ext) == os.path.splitext(path)


@pytest.mark.parametrize("raw,want", [
    ("Hello, world.", ["Hello", ",", "world", "."]),
    ("costs 1,000.50 dollars", ["costs", "1,000.50", "dollars"]),
    ("a-b 3-4", ["a-b", "3", "-", "4"]),
    ("x &amp; y &lt;z&gt;", ["x", "&", "y", "<", "z", ">"]),
    ("line-\nbreak\nnext", ["linebreak", "next"]),
    ("it's (ok)", ["it's", "(", "ok", ")"]),
])
def test_tokenize_13a(spark, raw, want):
    assert one(spark, T.tokenize_13a, raw) == want


def test_ws_tokens(spark):
    assert one(spark, T.ws_tokens, " a b\tc  ") == ["a", "b", "c"]
