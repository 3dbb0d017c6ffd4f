"""Volume distribution statistics.

Per-language statistics have only a handful of groups (three plot
languages), so every group is "hot". Nothing here collects a group's rows
into one task: aggregates combine map-side, and what is broadcast has a row
per plot language, a fixed list to which the rows are held.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .select import at_ranks

# Plot language labels and their order.
LANG_MAP = {"de_DE": "DE", "en_XX": "EN", "nl_XX": "NL"}
PLOT_LANG_ORDER = ["DE", "NL", "EN"]
KDE_POINTS = 100
# Bin width and kernel reach in bandwidths, and moments kept of each bin.
KDE_BIN, KDE_REACH, KDE_MOMENTS = 0.1, 8, 8


def stack_roles(df: DataFrame, with_file: bool = False) -> DataFrame:
    """Source side and target side as rows (term, language, SV, role) in one pass."""
    tcol = "target_norm" if "target_norm" in df.columns else "target"
    extra = [F.col("file")] if with_file else []
    src = F.struct(F.col("source").cast("string").alias("term"), F.col("src_lang").alias("language"),
                   F.col("volume").cast("string").alias("SV"), F.lit("source").alias("role"))
    tgt = F.struct(F.col(tcol).cast("string").alias("term"), F.col("tgt_lang").alias("language"),
                   F.col("actual_volume").cast("string").alias("SV"), F.lit("target").alias("role"))
    return df.select(*extra, F.inline(F.array(src, tgt)))


def map_language(c, mapping: dict[str, str] = LANG_MAP):
    """Literal map lookup; unmapped -> null (no join needed)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, T._c(c))


def long_volumes(df: DataFrame, with_file: bool = False) -> DataFrame:
    """U1 -> J4 -> F8 -> C8 -> C1 -> F9: the positive-volume long table."""
    s = stack_roles(df, with_file)
    s = s.withColumn("language", map_language("language"))
    s = s.where(F.col("language").isin(PLOT_LANG_ORDER))
    s = s.withColumn("SV", T.numeric_coerce("SV")).withColumn("term", T.py_strip("term"))
    return s.where(F.col("SV") > 0)


def max_volume_dedup(long_df: DataFrame) -> DataFrame:
    """A1: max SV per (role, language, term)."""
    return long_df.groupBy("role", "language", "term").agg(F.max("SV").alias("SV"))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, bounded: bool = True) -> DataFrame:
    """Exact linear-interpolation quantiles per group, by rank refinement
    (``select.py``); beside them n, lo, hi and total, the sum.

    Equal values are counted once, map-side combined; then bins are counted
    and the bin that holds a rank is split again. Nothing is sorted but the
    counts of bins and what the last bin holds, and no group's values meet in
    a task. Ranks ``floor/ceil(1 + p*(n-1))`` are interpolated as
    ``lo + f*(hi - lo)``. ``bounded``: the groups are few, so their ranges may
    be broadcast.
    """
    group = list(group)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    vals = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_w"))
    place = lambda n, p: F.lit(float(p)) * (n - 1).cast("double")
    ranks = [lambda n, p=p, up=up: up(place(n, p)) + 1 for p in probs for up in (F.floor, F.ceil)]
    at = at_ranks(vals, group, value, ranks, "_w", extra=[F.sum(F.col("_v") * F.col("_w")).alias("total")], log=True, bounded=bounded)

    def mixed(i: int, p: float) -> Column:
        lo, hi = F.col(f"at{2 * i}.{value}"), F.col(f"at{2 * i + 1}.{value}")
        return lo + (place(F.col("n"), p) - F.floor(place(F.col("n"), p))) * (hi - lo)

    return at.select(*group, "n", "lo", "hi", "total", *[mixed(i, p).alias(nm) for i, (p, nm) in enumerate(zip(probs, names, strict=True))])


def in_plot(df: DataFrame) -> DataFrame:
    """The rows of the plot languages: what bounds the number of groups of the statistics below."""
    return df.where(F.col("language").isin(PLOT_LANG_ORDER))


def volume_summary(dedup: DataFrame, approx: bool = False) -> DataFrame:
    """A2: count, min, median, max per language (roles pooled)."""
    if approx:
        return dedup.groupBy("language").agg(
            F.count("SV").alias("count"), F.min("SV").alias("min"),
            F.percentile_approx("SV", 0.5, 100000).cast("double").alias("median"),
            F.max("SV").alias("max"))
    q = exact_quantiles(in_plot(dedup), ["language"], "SV", [0.5], ["median"])
    return q.select("language", F.col("n").alias("count"), F.col("lo").alias("min"), "median", F.col("hi").alias("max"))


def violin_marks(dedup: DataFrame) -> DataFrame:
    """A11 marks: mean, median, min, max per language."""
    q = exact_quantiles(in_plot(dedup), ["language"], "SV", [0.5], ["median"])
    return q.select("language", (F.col("total") / F.col("n")).alias("mean"), "median", F.col("lo").alias("min"), F.col("hi").alias("max"))


def violin_density(dedup: DataFrame, points: int = KDE_POINTS) -> DataFrame:
    """A11 curve: Gaussian KDE (Scott bandwidth ``sd * n**(-1/5)``) on
    ``points`` evenly spaced values from min to max, per language.

    Values go into bins of a tenth of a bandwidth, of which only the first
    ``KDE_MOMENTS`` moments about the centre are kept: a task sends a row per
    bin, however many values there are. A grid point adds the bins within
    ``KDE_REACH`` bandwidths by the kernel's Hermite expansion,
    ``exp(-(t-u)^2/2) = exp(-t^2/2) * sum(u^j / j! * He_j(t))``. With
    ``|u| <= 0.05`` the first term left out is below 1e-13 of the kernel's peak,
    the bins out of reach below 2e-14, so the scaled curve is within
    ``1e-13 * (max - min) / bandwidth`` of the exact sum. Languages with one
    value or zero spread get no curve.
    """
    dedup = in_plot(dedup)
    st = dedup.groupBy("language").agg(
        F.count("SV").alias("n"), F.stddev_samp("SV").alias("sd"),
        F.min("SV").alias("lo"), F.max("SV").alias("hi"))
    st = st.where(F.col("sd").isNotNull() & (F.col("sd") > 0)) \
           .withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    bin_of = lambda x: F.floor((x - F.col("lo")) / (F.col("bw") * KDE_BIN))
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("bw") * KDE_BIN
    u = (F.col("SV") - centre) / F.col("bw")
    binned = dedup.where(F.col("SV").isNotNull()).join(F.broadcast(st), "language").withColumn("bin", bin_of(F.col("SV"))).withColumn("u", u)
    moments = binned.groupBy("language", "bin").agg(
        *[F.sum(F.pow("u", F.lit(float(j))) / math.factorial(j)).alias(f"m{j}") for j in range(KDE_MOMENTS)])
    reach = round(KDE_REACH / KDE_BIN)
    grid = st.select("language", "n", "bw", "lo", "hi",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")) \
             .withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(points - 1)) \
             .withColumn("bin", F.explode(F.sequence(bin_of(F.col("x")) - reach, bin_of(F.col("x")) + reach)))
    t = (F.col("x") - centre) / F.col("bw")
    hermite = [F.lit(1.0), t]
    for j in range(2, KDE_MOMENTS):
        hermite.append(t * hermite[-1] - (j - 1) * hermite[-2])
    kernel = F.exp(F.lit(-0.5) * t * t) * sum((F.col(f"m{j}") * h for j, h in enumerate(hermite)), F.lit(0.0))
    # plot languages x points x bins in reach, whatever the data; every grid point stays, also one that reaches no bin
    dens = grid.join(moments, ["language", "bin"], "left").groupBy("language", "i", "x", "n", "bw", "lo", "hi").agg(
        F.coalesce(F.sum(kernel), F.lit(0.0)).alias("_s"))
    d = F.col("_s") / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))
    return dens.select("language", F.col("i").cast("long").alias("i"), "x",
                       F.round(d * (F.col("hi") - F.col("lo")), 6).alias("density_scaled"))


def box_stats(dedup: DataFrame) -> DataFrame:
    """q1, median, q3, and whiskers at the last datum within 1.5 IQR."""
    dedup = in_plot(dedup)
    q = exact_quantiles(dedup, ["language"], "SV", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = dedup.join(F.broadcast(q), "language")   # one row per plot language
    w = j.groupBy("language", "q1", "median", "q3").agg(
        F.min(F.when(F.col("SV") >= F.col("_lo"), F.col("SV"))).alias("_wl"),
        F.max(F.when(F.col("SV") <= F.col("_hi"), F.col("SV"))).alias("_wh"))
    return w.select(
        "language", "q1", "median", "q3",
        F.when(F.col("_wl").isNull() | (F.col("_wl") > F.col("q1")), F.col("q1"))
         .otherwise(F.col("_wl")).alias("whislo"),
        F.when(F.col("_wh").isNull() | (F.col("_wh") < F.col("q3")), F.col("q3"))
         .otherwise(F.col("_wh")).alias("whishi"))


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns as null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
