"""Personal data: time and results on texts of very many matches."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lexispark.llm import pii


@pytest.mark.parametrize("n", [1, 63, 64, 65, 129, 5000])
def test_many_matches_have_their_places(spark, n):
    text = "é " + "".join(f"漢 a{i}@b.de, 10.0.0.{i % 256} +49 30 {1000000 + i}\n" for i in range(n)) + "x" * 3000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [tuple(s)[:3] for s in pii.find_pii(df).first().pii if s.kind in (0, 1, 3)]
    want = [(m.start(), m.end(), k) for k, p in ((0, r"a[0-9]+@b\.de"), (1, r"10\.0\.0\.[0-9]+(?= \+)"), (3, r"\+49 30 [0-9]+")) for m in re.finditer(p, text)]
    assert got == sorted(want)
    masked = pii.redact_pii(df).first().text
    plain, at = [], 0
    for s, e, k in sorted(want):
        plain += [text[at:s], f"<{pii.KINDS[k].name.upper()}>"]
        at = e
    assert masked == "".join(plain) + text[at:]


def test_time_is_linear_in_the_matches(spark):
    """A text of 40,000 addresses; the list of a state that is copied at each step would take minutes."""
    df = spark.createDataFrame([(1, " ".join(f"a{i}@b.de" for i in range(40_000)))], "doc_id long, text string")
    began = time.time()
    assert pii.find_pii(df).select(F.size("pii")).first()[0] == 40_000
    assert pii.redact_pii(df).first().text == " ".join(["<EMAIL>"] * 40_000)
    assert time.time() - began < 60


def test_iban_inside_another_is_part_of_it(spark):
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32, DE89370400440532013000; GB82WEST12345698765432")], "doc_id long, text string")
    spans = [tuple(s)[:3] for s in pii.find_pii(df).first().pii if s.kind == 4]
    assert spans == [(5, 32, 4), (34, 56, 4), (58, 80, 4)]


def test_a_column_named_as_the_helper_stays(spark):
    df = spark.createDataFrame([("a@b.de", "mine")], "text string, __pii string")
    assert tuple(pii.redact_pii(df).first()) == ("<EMAIL>", "mine")
