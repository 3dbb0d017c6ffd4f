import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import select, stats


def values(kind, rng, n):
    if kind == "ties":
        return [float(rng.randrange(5)) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "one":
        return [7.5] * n
    if kind == "outlier":
        return [1.0 + i * 1e-12 for i in range(n - 1)] + [1e15]
    return [float(rng.randrange(1, 10**9)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["even", "ties", "wide", "one", "outlier"])
@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_against_numpy(spark, kind, bounded):
    rng = random.Random(kind)
    groups = {g: values(kind, rng, n) for g, n in (("a", 1), ("b", 2), ("c", 401), ("d", 1000))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("c", None), ("e", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r.g: tuple(r)[5:] for r in stats.exact_quantiles(d, ["g"], "v", probs, bounded=bounded).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-12)


def test_few_bins_give_the_same(spark):
    vs = values("even", random.Random(3), 500)
    d = spark.createDataFrame([(v,) for v in vs], "v double")
    wanted = [1, 2, 250, 499, 500, 501, 0]
    r = select.at_ranks(d, [], "v", [lambda n, k=k: F.lit(k) for k in wanted], bins=2, rounds=3).first()
    assert [x and x.v for x in tuple(r)[3:]] == [*[sorted(vs)[k - 1] for k in wanted[:5]], None, None]
    assert (r.n, r.lo, r.hi) == (500, min(vs), max(vs))


def test_ties_are_ranked_by_the_tie_columns(spark):
    d = spark.createDataFrame([(1, t) for t in "dbca"] + [(0, "z"), (None, "n")], "v long, t string")
    r = select.at_ranks(d, [], "v", [lambda n, k=k: F.lit(k) for k in range(1, 6)], ties=["t"]).first()
    assert [x.t for x in tuple(r)[3:]] == list("zabcd")


def test_no_values(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert stats.exact_quantiles(d, ["g"], "v", [0.5]).count() == 0


def test_no_global_sort_and_no_checkpoint(spark):
    d = spark.createDataFrame([("DE", float(i)) for i in range(50)], "language string, SV double")
    for made in (stats.volume_summary(d), stats.violin_marks(d), stats.box_stats(d), stats.violin_density(d)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan.replace("Scan ExistingRDD[language", "")


def exact_density(vs, points):
    n, lo, hi = len(vs), min(vs), max(vs)
    bw = np.std(vs, ddof=1) * n ** -0.2
    xs = lo + np.arange(points) * (hi - lo) / (points - 1)
    z = (xs[:, None] - np.array(vs)[None, :]) / bw
    return xs, np.exp(-0.5 * z * z).sum(axis=1) / (n * bw * math.sqrt(2 * math.pi)) * (hi - lo)


@pytest.mark.parametrize("shape", ["even", "heavy", "two"])
def test_density_against_the_exact_sum(spark, shape):
    rng = np.random.default_rng(4)
    vs = {"even": rng.uniform(0, 1e5, 3000), "heavy": rng.lognormal(5, 2, 3000), "two": np.array([1.0, 1e6])}[shape].tolist()
    d = spark.createDataFrame([("DE", v) for v in vs] + [("EN", 3.0), ("NL", 2.0), ("NL", 2.0), ("FR", 1.0), ("FR", 9.0)], "language string, SV double")
    got = stats.violin_density(d).orderBy("i").collect()
    assert {r.language for r in got} == {"DE"}
    xs, want = exact_density(vs, stats.KDE_POINTS)
    assert np.allclose([r.x for r in got], xs) and np.abs(np.array([r.density_scaled for r in got]) - want).max() <= 1e-6


def test_density_work_does_not_grow_with_the_values(spark):
    """Rows that meet the grid: bins, not values."""
    d = spark.range(20_000).select(F.lit("DE").alias("language"), (F.col("id") * 1.7).alias("SV"))
    plan = stats.violin_density(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
