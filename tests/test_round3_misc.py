"""Funnel, route, roll-up and header discovery."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import lang as L
from lexispark.operators import ledger
from lexispark.operators import metrics as M
from lexispark.plans import prepare as P


def test_both_codes_of_a_pair(spark):
    rows = [("mbart50", "deu_Latn", "eng_Latn"), ("m2m100", "nld_Latn", "deu_Latn"), ("m2m100", "nld_Latn", "fra_Latn"),
            ("mbart50", None, "deu_Latn"), ("helsinki", "fra_Latn", None), ("other", "deu_Latn", "eng_Latn")]
    d = spark.createDataFrame(rows, "f string, a string, b string")
    got = [r.p and tuple(r.p) for r in d.select(L.family_pair("f", "a", "b", on_error="null").alias("p")).collect()]
    assert got == [("de_DE", "en_XX"), ("nl", "de"), None, None, (None, None), None]
    for at, text in ((2, "fra_Latn -> none"), (3, "null -> none"), (5, "found other")):
        with pytest.raises(Exception, match=text):
            spark.createDataFrame(rows[at:at + 1], "f string, a string, b string").select(L.family_pair("f", "a", "b")).collect()


def test_pair_messages_say_what_was_expected(spark):
    for pair, text in (("deen", "joined by '-'"), ("de-fr", "one of de, en, nl"), ("deu_Latn-en", "both are long")):
        with pytest.raises(Exception, match=text):
            spark.createDataFrame([(pair,)], "p string").select(L.resolve_lang_pair("p")["src"]).collect()


KW = "ord long, source string, src_lang string, target string, tgt_lang string, volume long, actual_volume long"


def test_funnel_counts_each_stage(spark):
    rows = [(0, "red shoes", "a", "rote schuhe", "b", 1, 5), (1, "red shoes", "a", "Rote Schuhe.", "b", 1, 9), (2, "red shoes", "a", "x y", "b", 1, 0),
            (3, "red shoes", "a", "z", "b", 1, 5), (4, "red shoes", "a", "webs", "b", 1, 5), (5, "blue", "a", "blau", "b", 1, None), (6, None, "a", "blau", "b", 1, 4),
            (7, "green hat", "a", "hut", "b", 1, 4)]
    got = {r.stage: r.rows for r in P.stage_funnel(spark.createDataFrame(rows, KW)).collect()}
    assert got == {"input": 8, "min_volume": 6, "length_band": 4, "valid_candidate": 3, "dedup_keep_first": 2, "clean_full": 2, "train": 1, "eval": 1}
    none = {r.stage: r.rows for r in P.stage_funnel(spark.createDataFrame([], KW)).collect()}
    assert set(none.values()) == {0} and len(none) == 8


def test_rollup_by_broadcast_and_by_salt(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None, i / 10) for i in range(60)], "id long, system string, comet_score_segment double")
    few = sorted(map(tuple, M.comet_rollup(d).select("id", "comet_score_system").collect()))
    plan = M.comet_rollup(d)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(M, "FEW_SYSTEMS", 2)
    assert sorted(map(tuple, M.comet_rollup(d).select("id", "comet_score_system").collect())) == few


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(12):
        folder = tmp_path / "fam one" / "de_en"
        folder.mkdir(parents=True, exist_ok=True)
        head = ["source,target,prediction", 'input,target,"prediction"'][i % 2]
        (folder / f"m_de_en_v{i}_eval.csv").write_text(("\ufeff" if i == 3 else "") + f"{head}\na{i},b,c\n", encoding="utf-8")
    (tmp_path / "fam one" / "de_en" / "m_de_en_none_eval.csv").write_text("")
    paths = sorted(str(p) for p in tmp_path.rglob("*.csv"))
    assert len(ledger.file_headers(spark, paths)) == 12
    got = ledger.read_result_files(spark, paths)
    assert sorted((r.variant, r.source) for r in got.collect()) == sorted((f"v{i}", f"a{i}") for i in range(12))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "")
    ledger.read_result_files(spark, paths[:2])
    spark.sparkContext.setJobGroup("many", "")
    ledger.read_result_files(spark, paths)
    assert len(tracker.getJobIdsForGroup("few")) == len(tracker.getJobIdsForGroup("many"))
    with pytest.raises(ValueError):
        ledger.read_result_files(spark, [])


def test_stream_with_a_watermark(spark, tmp_path):
    from lexispark.streaming import incremental
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("ord,source,src_lang,target,tgt_lang,volume,actual_volume,ts\n"
                                           "0,red,a,rot,b,1,5,2024-01-01 00:00:00\n1,red,a,rot,b,1,5,2024-01-01 00:01:00\n")
    q = incremental.start_csv_stream(spark, str(tmp_path / "in"), KW + ", ts timestamp", str(tmp_path / "out"), watermark_col="ts", delay="10 minutes")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("target")).count() == 1
    assert "EventTimeWatermark" in q._jsq.lastProgress().toString() or "watermark" in q._jsq.lastProgress().json()
