"""Selection by rank refinement: values at given ranks without sorting the rows.

A round splits the range that still holds a rank into bins, counts the rows
of each and keeps the bin in which the running sum passes the rank. The bin's
own least and greatest value are the next range, and a bin of one value stays
one. What is left after the rounds is ranked exactly: of values spread evenly,
or on the first round's logarithmic scale, the part ``1 / bins ** rounds``.
Counts combine on the map side: a task sends a row per bin at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, ROUNDS = 4096, 2


def _scaled(v: Column, log: bool) -> Column:
    """A rising function of the value: itself, or on a logarithmic scale on either side of 0."""
    v = v.cast("double")
    return F.signum(v) * F.log1p(F.abs(v)) if log else v


def _bin(lo: Column, hi: Column, bins: int, log: bool) -> Column:
    """The bin of ``_v`` in [lo, hi]; any rising function will do, so rounding is harmless."""
    at, least, most = (_scaled(c, log) for c in (F.col("_v"), lo, hi))
    return F.when(most > least, F.least(F.lit(bins - 1), F.floor((at - least) / (most - least) * bins))).otherwise(0).cast("int")


def at_ranks(rows: DataFrame, group: Sequence[str], value: str, ranks: Sequence[Callable[[Column], Column]],
             weight: str | None = None, ties: Sequence[str] = (), extra: Sequence[Column] = (), bins: int = BINS,
             rounds: int = ROUNDS, log: bool = False, bounded: bool = True, span: tuple[int, int] | None = None) -> DataFrame:
    """One row per group: the group, n, lo, hi, ``extra`` aggregates and for each i of ``ranks`` at{i}, a struct of
    ``value`` and ``ties`` of the row at rank ``ranks[i](n)``, from 1.

    Rows are ordered by (value, ties), which together are unique; a row counts
    ``weight`` times and n is their sum. Null values have no rank; a rank
    outside 1 to n gives null. ``extra`` may use ``_v`` and ``_w``, value and
    weight. Without ``group`` there is one row, also for no rows. Ranges meet
    the rows by a broadcast while the caller vouches for few groups
    (``bounded``), otherwise as Spark sees fit. With ``span``, known bounds of
    all values, and no group, a pass is saved; the row has at{i} only.
    """
    group, ties = list(group), list(ties)
    few = F.broadcast if bounded else lambda d: d
    keyed = rows.where(F.col(value).isNotNull()).select(
        F.struct(*group, F.lit(0)).alias("_g"), F.col(value).alias("_v"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    wanted = F.array(*[F.struct(F.lit(i).alias("_id"), f(F.col("n")).cast("long").alias("_rank")) for i, f in enumerate(ranks)])

    def summed(hist: DataFrame, by: list[str]) -> DataFrame:
        run = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # <= bins rows
        return hist.withColumn("_upto", F.col("_before") + F.sum("_c").over(run)).withColumn("_from", F.col("_upto") - F.col("_c"))

    def counts(met: DataFrame, lo: str, hi: str, by: list[str], log: bool) -> DataFrame:
        return met.groupBy(*by, _bin(F.col(lo), F.col(hi), bins, log).alias("_bin")).agg(
            F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    if span:
        first = counts(keyed.select("*", F.lit(span[0]).alias("_l"), F.lit(span[1]).alias("_h")), "_l", "_h", ["_g"], log)
        first = summed(first.withColumn("_before", F.lit(0).cast("long")), ["_g"])
        held = first.withColumn("n", F.sum("_c").over(Window.partitionBy("_g"))).select("*", F.inline(wanted))
    else:
        ends = [F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), *extra]
        # without a group, the key comes after the aggregate, which gives a row for no rows too
        state = keyed.groupBy("_g").agg(*ends) if group else keyed.agg(*ends).withColumn("_g", F.struct(F.lit(0)))
        known = [c for c in state.columns if c != "_g"]
        state = state.withColumn("_ranks", wanted)
        first = counts(keyed.join(few(state.select("_g", "lo", "hi")), "_g"), "lo", "hi", ["_g"], log)
        first = summed(first.withColumn("_before", F.lit(0).cast("long")), ["_g"])
        held = first.join(few(state), "_g").select("_g", "_lo", "_hi", "_from", "_upto", F.inline("_ranks"))
    inside = (F.col("_from") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))
    targets = held.where(inside).select("_g", "_id", "_rank", "_lo", "_hi", F.col("_from").alias("_before"))

    def within() -> DataFrame:
        return keyed.join(few(targets), "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    for _ in range(rounds - 1):
        met = within().withColumnsRenamed({"_lo": "_l", "_hi": "_h"})
        hist = summed(counts(met, "_l", "_h", ["_g", "_id", "_rank", "_before", "_l", "_h"], False), ["_g", "_id"])
        targets = hist.where(inside).select("_g", "_id", "_rank", "_lo", "_hi", F.col("_from").alias("_before"))
    run = Window.partitionBy("_g", "_id").orderBy("_v", *[f"_t{i}" for i in range(len(ties))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = within().withColumn("_upto", F.col("_before") + F.sum("_w").over(run)).withColumn("_from", F.col("_upto") - F.col("_w"))
    row = F.struct(F.col("_v").alias(value), *[F.col(f"_t{i}").alias(t) for i, t in enumerate(ties)])
    found = [F.max(F.when(F.col("_id") == i, row)).alias(f"at{i}") for i in range(len(ranks))]
    if span:
        return last.where(inside).agg(*found)
    out = state.join(few(last.where(inside).groupBy("_g").agg(*found)), "_g", "left")
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in group], *known, *[f"at{i}" for i in range(len(ranks))])
