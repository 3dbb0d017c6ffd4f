"""Leak-free splits, volume buckets and up-weighting.

Exact-size hash splits without a global rank
--------------------------------------------
Rows (or groups) are ordered by ``md5('{seed}:{key}')``. A split of exact
size needs the key at position ``cut`` of that order. The hash's first 60
bits are a number, and the number at a rank is found by refinement
(``select.py``): a round counts the keys of 65,536 bins and the next one
splits the bin that holds the cut. Two rounds leave the 2^32nd part of the
keys, some tens at most, which are ranked by (hash, key).

The result is a one-row threshold ``(h, key)``; every row is then
labelled map-side by comparing its own hash with it (broadcast of one
row). No join on the key, no shuffle of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .rank import hash_key
from .select import at_ranks

#: Bins of a round, and rounds.
CUT_BINS, CUT_ROUNDS = 1 << 16, 2


def _thresholds(keys: DataFrame, key: str, cuts: Sequence[Callable[[Column], Column]], bins: int) -> DataFrame:
    """One row: for each cut i, struct(_h, key) of the key at 1-based position cut_i(n).

    ``keys`` has unique ``(_h, key)`` rows. A cut of 0 (or beyond n) gives null.
    """
    numbers = keys.withColumn("_v", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    found = at_ranks(numbers, [], "_v", cuts, ties=["_h", key], bins=bins, rounds=CUT_ROUNDS, span=(0, 16 ** 15 - 1))
    return found.select(*[F.col(f"at{i}").alias(f"_t{i}") for i in range(len(cuts))])


def _le(h: Column, k: Column, th: Column, key: str) -> Column:
    """(h, k) <= threshold struct (null threshold -> False)."""
    return F.coalesce((h < th["_h"]) | ((h == th["_h"]) & (k <= th[key])), F.lit(False))


def hash_cut_labels(df: DataFrame, key: str, seed: int,
                    cuts: Sequence[Callable[[Column], Column]], labels: Sequence[str],
                    label_col: str = "split", bins: int = CUT_BINS,
                    materialize: bool = True, unique: bool = False) -> DataFrame:
    """Label rows by position of ``hash(key)`` among distinct keys.

    ``labels[i]`` goes to keys at positions ``<= cuts[i](n)`` (first match
    wins); the last label (``labels[len(cuts)]``) to the rest; null keys
    get the last label. ``unique``: no two rows share a key, so keys need not
    be made distinct and nothing but bin counts is shuffled.

    The input feeds several branches (bin counts, the cut's bin, rows). With
    ``materialize`` it is written once to the shared folder, so an expensive
    upstream plan (dedup + top-k shuffles) runs once, the counting branches
    read the key column alone, and the lineage is cut for executor loss.
    """
    if materialize:
        df = stored(df, "split")
    h = hash_key(seed, key)
    keys = df.select(key).where(F.col(key).isNotNull())
    keys = (keys if unique else keys.distinct()).withColumn("_h", h)
    th = _thresholds(keys, key, cuts, bins)
    x = df.withColumn("_h", h).join(F.broadcast(th), on=F.lit(True), how="left")
    lab = F.lit(labels[-1])
    for i in reversed(range(len(cuts))):
        lab = F.when(_le(F.col("_h"), F.col(key), F.col(f"_t{i}"), key), F.lit(labels[i])) \
            .otherwise(lab)
    return x.withColumn(label_col, lab).drop("_h", *[f"_t{i}" for i in range(len(cuts))])


def group_split(df: DataFrame, key: str = "source", train_frac: float = 0.9, seed: int = 42,
                label_col: str = "split", bins: int = CUT_BINS, materialize: bool = True) -> DataFrame:
    """First ``int(n_keys * train_frac)`` keys in seeded hash order -> 'train'.

    Same size and disjointness as a seeded shuffle of unique keys; the
    members differ from numpy's RNG, which is not reproducible here.
    """
    cut = lambda n: F.floor(n * F.lit(float(train_frac)))
    return hash_cut_labels(df, key, seed, [cut], ["train", "eval"], label_col, bins, materialize)


def three_way_split(df: DataFrame, key: str = "ord", test_size: float = 0.10,
                    dev_size: float = 0.1111, seed: int = 42, label_col: str = "split",
                    bins: int = CUT_BINS, materialize: bool = True) -> DataFrame:
    """test = ceil(test_size*N) rows, dev = ceil(dev_size*(N-test)), rest train.

    Row-level: ``key`` is unique per row (a position or id), so equal pairs
    may straddle splits.
    """
    n_test = lambda n: F.ceil(n * F.lit(float(test_size)))
    n_upto_dev = lambda n: F.ceil(n * F.lit(float(test_size))) + \
        F.ceil((n - F.ceil(n * F.lit(float(test_size)))) * F.lit(float(dev_size)))
    return hash_cut_labels(df, key, seed, [n_test, n_upto_dev], ["test", "dev", "train"],
                           label_col, bins, materialize, unique=True)


def threshold_split(df: DataFrame, key: str = "source", train_frac: float = 0.9, seed: int = 42,
                    label_col: str = "split") -> DataFrame:
    """X1, ``mode='threshold'``: hash < frac -> train. No ranking at all;
    approximate size, membership stable as data grows. Works on streams."""
    u = F.conv(F.substring(hash_key(seed, key), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return df.withColumn(label_col, F.when(u < train_frac, "train").otherwise("eval"))


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys`` (AQE broadcasts a small key side)."""
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The complement (a null key lands here)."""
    return df.join(keys, on, "left_anti")


def volume_bucket(c) -> Column:
    """Right-closed buckets (-1,100]->1, (100,1e3]->2, (1e3,1e4]->3,
    (1e4,1e5]->4, (1e5,inf]->5; <= -1, null and NaN -> null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (F.when(v.isNull() | F.isnan(v) | (v <= -1), F.lit(None))
            .when(v <= 100, 1).when(v <= 1_000, 2).when(v <= 10_000, 3)
            .when(v <= 100_000, 4).otherwise(5)).cast("int")


def upweight(df: DataFrame, bucket_col: str = "sv_bucket") -> DataFrame:
    """Replicate each row ``bucket`` times (explode of a sequence); a row without a bucket is an error."""
    times = F.when(F.col(bucket_col).isNull(), F.raise_error(F.lit(f"row without {bucket_col}")).cast("int")).otherwise(F.col(bucket_col))
    return df.withColumn("_rep", F.explode(F.sequence(F.lit(1), times))).drop("_rep")
