import pytest
from pyspark.sql import functions as F

from lexispark.functions import lang as L
from lexispark.session import scratch_path
from lexispark.sources import io


def test_csv_na_words_and_doubled_quotes(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('source,target\nnull,"QiMo (""x"")"\nNone,none\nn/a,Null\n#N/A,a\n,b\nNA,c\nnan,d\n',
                 encoding="utf-8")
    d = io.read_csv(spark, str(p), "source string, target string", missing="pandas")
    rows = sorted(d.collect(), key=lambda r: r.ord)
    assert [r.source for r in rows] == [None] * 7
    assert [r.target for r in rows] == ['QiMo ("x")', "none", "Null", "a", "b", "c", "d"]


def test_csv_write_keeps_whitespace(spark):
    d = spark.createDataFrame([("  padded ", "x")], "a string, b string")
    path = scratch_path(spark, "ws")
    io.write_table(d, path, fmt="csv")
    assert io.read_csv(spark, path, "a string, b string", with_ord=False).first().a == "  padded "


def test_keyword_export_utf16(spark, tmp_path):
    p = tmp_path / "export.tsv"
    text = '"#"\tKeyword\tVolume\tSERP Features\tIntents\tExtra\n1\tkw one\t590\tsnippet\tinfo\tz\n2\tkw two\t10\t\tnav\tz\n'
    p.write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
    d = io.read_keyword_export(spark, str(p), include_intents=True)
    assert d.columns == ["ID", "Keyword", "Volume", "SERP Features", "Intents"]
    assert [tuple(r) for r in d.orderBy("ID").collect()] == [
        (1, "kw one", 590, "snippet", "info"), (2, "kw two", 10, None, "nav")]
    with pytest.raises(KeyError):
        io.prune_columns(d, ["ID", "Missing"])


def test_header_clean_name():
    assert io.clean_header_name('﻿"#"') == "ID"
    assert io.clean_header_name(' "SERP Features" ') == "SERP Features"


def test_dict_literal(spark):
    d = spark.createDataFrame([("{'de': 'Hallo', 'en': \"It's\"}",), ("{'de': 'x'}",), ("{'de': ",)], "t string")
    rows = d.select(io.parse_dict_literal("t").alias("m")).collect()
    assert rows[0].m == {"de": "Hallo", "en": "It's"}
    assert rows[1].m == {"de": "x"}
    assert rows[2].m is None


def test_positional_id_dense(spark):
    d = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).drop("id")
    out = io.positional_id(d, ["k"], "pos")
    got = sorted((r.k, r.pos) for r in out.collect())
    assert [p for _, p in got] == list(range(1000))


def test_resolve_lang_pair(spark):
    d = spark.createDataFrame([("de-en",), ("deu_Latn-eng_Latn",)], "p string")
    got = [tuple(r.r) for r in d.select(L.resolve_lang_pair("p").alias("r")).collect()]
    assert got == [("deu_Latn", "eng_Latn"), ("deu_Latn", "eng_Latn")]


@pytest.mark.parametrize("bad", ["deen", "de-fr", "deu_Latn-en"])
def test_resolve_lang_pair_errors(spark, bad):
    d = spark.createDataFrame([(bad,)], "p string")
    with pytest.raises(Exception):
        d.select(L.resolve_lang_pair("p").alias("r")).collect()
    assert d.select(L.resolve_lang_pair("p", on_error="null").alias("r")).first().r.src is None


def test_family_code(spark):
    d = spark.createDataFrame([("mbart50", "nld_Latn"), ("m2m100", "deu_Latn"), ("helsinki", "eng_Latn")],
                              "f string, c string")
    assert [r.x for r in d.select(L.family_code("f", "c").alias("x")).collect()] == ["nl_XX", "de", None]
    bad = spark.createDataFrame([("m2m100", "fra_Latn")], "f string, c string")
    with pytest.raises(Exception):
        bad.select(L.family_code("f", "c")).collect()


def test_header_names_follow_the_unquote_rule():
    from lexispark.sources.io import clean_header_name as name

    assert [name(x) for x in ('\ufeff"#"', " Keyword ", '"SERP Features"', '"', "Vol\x00ume", '""')] == [
        "ID", "Keyword", "SERP Features", '"', "Volume", ""]


def test_export_with_crlf_line_ends(spark, tmp_path):
    from lexispark.sources import io

    body = "\ufeff\"#\"\tKeyword\tVolume\tSERP Features\tIntents\r\n1\tred shoes\t590\tImages\tInfo\r\n2\tblue\t10\t\tNav\r\n"
    (tmp_path / "e.csv").write_bytes(body.encode("utf-16-le"))
    got = sorted(tuple(r) for r in io.read_keyword_export(spark, str(tmp_path / "e.csv")).collect())
    assert got == [(1, "red shoes", 590, "Images", "Info"), (2, "blue", 10, None, "Nav")]


def test_a_missing_volume_prints_all_volumes_as_float(spark):
    from lexispark.operators import bitext

    src = spark.createDataFrame([(0, "a", 590, "s", "i"), (1, "b", None, "s", "i")],
                                "ord long, Keyword string, Volume long, `SERP Features` string, Intents string")
    out = sorted(r.input for r in bitext.build_parallel(src, src, missing="pandas").collect())
    assert out == ["Keyword: a | Volume: 590.0 | SERP: s | Intents: i", "Keyword: b | Volume: nan | SERP: s | Intents: i"]


def test_csv_order_follows_paths_and_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "\n".join(str(i) for i in range(3)) + "\n")
    (tmp_path / "b.csv").write_text("n\n" + "\n".join(str(i) for i in range(3, 4003)) + "\n")
    d = io.read_csv(spark, f"{tmp_path}/*.csv", "n long")
    assert [r.n for r in d.orderBy("ord").collect()] == list(range(4003))


def test_unmatched_glob_is_empty_only_with_a_schema(spark, tmp_path):
    d = io.read_csv(spark, f"{tmp_path}/*.csv", "n long, t string", with_file=True)
    assert d.columns == ["n", "t", "ord", "file_path", "file"] and d.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_csv(spark, f"{tmp_path}/*.csv")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_csv(spark, f"{tmp_path}/plain.csv", "n long")


def test_dict_literal_as_python_prints_it(spark):
    import ast
    texts = [repr({"de": "a\xa0b", "en": None}), repr({"de": "it's: None, \"so\"", "en": "\\x41"}), repr({"en": "None", "de": "N'one"})]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.m for r in d.select(io.parse_dict_literal("t").alias("m")).collect()] == [ast.literal_eval(t) for t in texts]
    with pytest.raises(Exception, match="no dict literal"):
        spark.createDataFrame([("{'de': ",)], "t string").select(io.parse_dict_literal("t", "raise")).collect()
