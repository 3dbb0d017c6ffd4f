import math

from pyspark.sql import functions as F

from lexispark.operators import split


def keys(spark, n):
    return spark.createDataFrame([(i, f"src{i % (n // 2 + 1)}") for i in range(n)], "ord long, source string")


def test_group_split_exact_size_disjoint(spark):
    d = keys(spark, 701)
    out = split.group_split(d, "source", 0.9, 42)
    n_src = d.select("source").distinct().count()
    train = out.where(F.col("split") == "train").select("source").distinct()
    evl = out.where(F.col("split") == "eval").select("source").distinct()
    assert train.count() == math.floor(n_src * 0.9)
    assert train.intersect(evl).count() == 0
    assert train.count() + evl.count() == n_src
    assert out.count() == d.count()


def test_group_split_bins_do_not_change_result(spark):
    d = keys(spark, 400)
    a = split.group_split(d, "source", 0.7, 7, bins=2)
    b = split.group_split(d, "source", 0.7, 7)
    s = lambda x: sorted((r.ord, r.split) for r in x.collect())
    assert s(a) == s(b)


def test_splits_against_a_plain_ranking(spark):
    import hashlib
    h = lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest()
    d = keys(spark, 603)
    names = sorted({r.source for r in d.collect()}, key=lambda x: (h(x), x))
    train = set(names[:math.floor(len(names) * 0.9)])
    assert {(r.ord, r.split) for r in split.group_split(d, "source", 0.9, 42).collect()} == {
        (r.ord, "train" if r.source in train else "eval") for r in d.collect()}
    ids = sorted(range(603), key=lambda x: (h(x), x))
    test, dev = ids[:61], ids[61:61 + math.ceil(0.1111 * 542)]
    got = {r.ord: r.split for r in split.three_way_split(d).collect()}
    assert got == {i: "test" if i in test else "dev" if i in dev else "train" for i in ids}


def test_unique_keys_are_not_made_distinct(spark):
    d = split.three_way_split(spark.range(100).toDF("ord"), materialize=False)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    rows = [x for x in plan.splitlines() if "Aggregate [ord#" in x or "Aggregate [_h#" in x]
    assert not rows
    null = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "ord long, t string")
    assert {r.ord: r.split for r in split.three_way_split(null, test_size=0.5, dev_size=0.0).collect()}[None] == "train"


def test_three_way_sizes(spark):
    n = 1000
    d = spark.range(n).withColumnRenamed("id", "ord")
    got = {r.split: r["count"] for r in split.three_way_split(d).groupBy("split").count().collect()}
    n_test = math.ceil(0.1 * n)
    n_dev = math.ceil(0.1111 * (n - n_test))
    assert got == {"test": n_test, "dev": n_dev, "train": n - n_test - n_dev}


def test_small_cut_zero(spark):
    d = spark.createDataFrame([(0, "a")], "ord long, source string")
    out = split.group_split(d, "source", 0.5, 1)
    assert [r.split for r in out.collect()] == ["eval"]


def test_upweight_count(spark):
    vols = [0.0, 100.0, 100.5, 5000.0, 20000.0, 1e6]
    d = spark.createDataFrame([(v,) for v in vols], "v double").withColumn("b", split.volume_bucket("v"))
    assert split.upweight(d, "b").count() == 1 + 1 + 2 + 3 + 4 + 5


def test_threshold_split_is_stable(spark):
    d = keys(spark, 300)
    a = split.threshold_split(d, "source", 0.8, 3).collect()
    b = split.threshold_split(d.repartition(5), "source", 0.8, 3).collect()
    assert sorted((r.ord, r.split) for r in a) == sorted((r.ord, r.split) for r in b)
