from pyspark.sql import functions as F

from conftest import SF
from lexispark.plans import prepare as P
from lexispark.session import scratch_path
from lexispark.sources import fixtures as fx


def test_l1_write_outputs(spark):
    kw = fx.kw(spark, SF)
    cfg = P.PrepConfig(topk_per_source=2)
    out = scratch_path(spark, "l1-out")
    P.write_outputs(kw, out, cfg, make_upweighted=True, fmt="csv")
    read = lambda p: spark.read.option("header", True).csv(f"{out}/{p}")
    full, pairs, up = read("clean_full"), read("pairs"), read("train_upweighted")
    assert full.count() == P.clean_full(kw, cfg).count()
    assert pairs.count() == full.count()
    assert set(r.split for r in pairs.select("split").distinct().collect()) <= {"train", "eval"}
    assert pairs.columns[:2] == ["input", "target"]
    n_train = pairs.where(F.col("split") == "train").count()
    assert up.count() >= n_train
    # leak-free: no input on both sides
    tr = pairs.where("split = 'train'").select("input").distinct()
    ev = pairs.where("split = 'eval'").select("input").distinct()
    assert tr.intersect(ev).count() == 0
