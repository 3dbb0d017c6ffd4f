from pyspark.sql import functions as F

from lexispark.operators import clean, rank
from lexispark.plans import prepare as P

ROWS = [
    # ord, source, src_lang, target, tgt_lang, actual_volume
    (0, "s1", "en_XX", "Alpha", "de_DE", 10),
    (1, "s1", "en_XX", "alpha.", "de_DE", 500),    # same target_norm, later -> dropped
    (2, "s1", "en_XX", "beta", "de_DE", 50),
    (3, "s1", "en_XX", "gamma", "de_DE", 50),       # tie with beta -> input order
    (4, "s1", "en_XX", "delta", "de_DE", None),     # null volume -> last (and F1 drops it)
    (5, "s2", "en_XX", "webs", "de_DE", 99),        # stop target
    (6, "s2", "en_XX", "two  spaces", "de_DE", 99),  # double space
    (7, "s2", "en_XX", "x", "de_DE", 99),           # too short
    (8, "s2", "en_XX", "ok", "de_DE", 0),           # below min volume
    (9, "s2", "en_XX", "fine", "de_DE", 7),
]
SCHEMA = "ord long, source string, src_lang string, target string, tgt_lang string, actual_volume long"


def df(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_l1_topk_semantics(spark):
    out = P.clean_full(df(spark), P.PrepConfig(topk_per_source=2))
    got = sorted((r.source, r.ord) for r in out.collect())
    # s1: dedup keeps ord 0 (first), then top-2 by volume desc: beta(50, ord2), gamma(50, ord3)
    assert got == [("s1", 2), ("s1", 3), ("s2", 9)]


def test_dedup_keeps_first_not_highest(spark):
    out = clean.dedup_keep_first(df(spark).withColumn("k", F.lit(1)), ["source", "k"], "ord")
    assert sorted(r.ord for r in out.collect()) == [0, 5]


def test_dedup_idempotent_and_partition_independent(spark):
    d = df(spark).withColumn("tn", F.lower("target"))
    a = clean.dedup_keep_first(d, ["source", "tn"], "ord")
    b = clean.dedup_keep_first(a, ["source", "tn"], "ord")
    c = clean.dedup_keep_first(d.repartition(1), ["source", "tn"], "ord")
    key = lambda x: sorted(tuple(r) for r in x.collect())
    assert key(a) == key(b) == key(c)


def test_topk_nulls_last_ties_by_ord(spark):
    rows = [(0, "s", "a", None), (1, "s", "b", 5), (2, "s", "c", 5), (3, "s", "d", 7)]
    d = spark.createDataFrame(rows, "ord long, source string, target string, actual_volume long")
    out = rank.topk_per_source(d, 3)
    assert sorted(r.ord for r in out.collect()) == [1, 2, 3]
    out4 = rank.topk_per_source(d, 4)
    assert sorted(r.ord for r in out4.collect()) == [0, 1, 2, 3]


def test_topk_hot_key_plan_has_partial_group_limit(spark):
    rows = [(i, "hot" if i % 3 else f"s{i}", f"t{i}", i) for i in range(3000)]
    d = spark.createDataFrame(rows, "ord long, source string, target string, actual_volume long")
    out = rank.topk_per_source(d, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = {r.source: r.ord for r in out.where(F.col("source") == "hot").collect()}
    assert out.where(F.col("source") == "hot").count() == 2


def test_candidate_trim_drops_missing_source(spark):
    rows = [(0, None, "a", 1), (1, "s", "b", 2)]
    d = spark.createDataFrame(rows, "ord long, source string, target string, volume long")
    out = rank.candidate_trim(d, 5, "volume")
    assert [r.ord for r in out.collect()] == [1]


def test_require_columns_raises(spark):
    import pytest
    with pytest.raises(KeyError, match="actual_volume"):
        P.clean_full(df(spark).drop("actual_volume"))


def test_pandas_missing_mode_keeps_nan_literal(spark):
    rows = [(0, "src", "en_XX", None, "de_DE", 5)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert P.clean_full(d, P.PrepConfig(missing="null")).count() == 0
    out = P.clean_full(d, P.PrepConfig(missing="pandas")).first()
    assert (out.target, out.target_norm) == ("nan", "nan")


def test_funnel_counts(spark):
    f = {r.stage: r.rows for r in P.stage_funnel(df(spark), P.PrepConfig(topk_per_source=2)).collect()}
    assert f["input"] == 10 and f["min_volume"] == 8 and f["valid_candidate"] == 5
    assert f["dedup_keep_first"] == 4 and f["clean_full"] == 3
    assert f["train"] + f["eval"] == f["clean_full"]
