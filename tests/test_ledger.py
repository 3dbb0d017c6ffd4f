from lexispark.operators import ledger
from lexispark.plans import queries_io


def _file(root, path, header, rows):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return str(p)


def test_pair_and_variant_come_from_the_name(spark, tmp_path):
    names = {"one/de_en/m_de_en_sv_up_eval.csv": ("one", "de_en", "de_en", "sv_up"),
             "one/de_nl/m_en_nl_pre_eval.csv": ("one", "en_nl", "de_nl", "pre"),
             "two/m25_7b_de_nl_eval.csv": ("two", "de_nl", "", ""),
             "two/en_nl/m_en_nl_sv-up_eval.csv": ("two", "en_nl", "en_nl", "sv-up")}
    heads = ["source,target,id,prediction", "input,target,prediction"]
    paths = [_file(tmp_path, n, heads[i % 2], ["a,b,1,007"] if i % 2 == 0 else ["a,b,007"]) for i, n in enumerate(names)]
    led = ledger.read_result_files(spark, paths)
    got = sorted((r.family, r.pair, r.folder_pair, r.variant, r.prediction) for r in led.collect())
    assert got == sorted((*v, "007") for v in names.values())


def test_audit_flags_wrong_pairs_and_duplicates(spark):
    rows = [("r1", "de_en", "s1", "p"), ("r2", "de_en", "s1", "q"), ("r3", "de_nl", "s1", "z"), ("r4", "en_nl", "s4", "q"),
            ("r5", "en_nl", "s5", None), ("r6", "en_nl", "s6", "")]
    led = spark.createDataFrame(rows, "run string, pair string, source string, prediction string")
    out = {r.run: r for r in ledger.run_set_audit(led, "run", "pair").collect()}
    assert [out[f"r{i}"].wrong_pair for i in range(1, 7)] == [True, True, True, False, False, False]
    assert [out[f"r{i}"].duplicate_of for i in range(1, 7)] == [None, "r4", None, "r2", None, None]
    assert out["r5"].n_missing == out["r6"].n_missing == 1 and out["r5"].pred_fp != out["r6"].pred_fp


def test_fixture_holds_the_faults_it_is_for(spark):
    led = queries_io.q_run_set_audit(spark, "/root/testdata/sf0.001").collect()
    assert {r.wrong_pair for r in led} == {True, False} and any(r.duplicate_of for r in led)
