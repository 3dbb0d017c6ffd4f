"""Top-k, sorts, limits and samples.

Top-k is ``row_number() <= k`` over a window; Spark plans a partial
``WindowGroupLimit`` before the exchange, so each map task ships at most
k rows per key -- a hot key costs k rows per task, not a third of the
table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols: Iterable) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def topk_per_key(df: DataFrame, keys: Iterable[str], order: Iterable, k: int,
                 rank_col: str | None = None) -> DataFrame:
    """Keep the first k rows of each key under a total ``order`` (make it total:
    end with a unique tie-break such as ``ord``)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def topk_per_source(df: DataFrame, k: int = 1, by: str = "actual_volume",
                    key: str = "source", order_col: str = "ord") -> DataFrame:
    """Top-k per source by ``by`` desc, nulls last, ties in input order."""
    return topk_per_key(df, [key], [F.col(by).desc_nulls_last(), F.col(order_col)], k)


def candidate_trim(df: DataFrame, k: int = 5, sort_by: str = "volume",
                   key: str = "source", group_cols: Iterable[str] = (),
                   tiebreak: Iterable[str] = ("ord",)) -> DataFrame:
    """Top-k per (file, source) by ``sort_by`` desc; missing source dropped.

    ``sort_by`` is usually constant within a source, so the reference's
    unstable sort left the order inside a source arbitrary; ours breaks ties
    by ``tiebreak`` (candidate rank / input order).
    """
    df = df.where(F.col(key).isNotNull())
    order = [F.col(sort_by).desc_nulls_last(), *_order(tiebreak)]
    return topk_per_key(df, [*group_cols, key], order, k)


def sort_rank(df: DataFrame, order: Iterable, rank_col: str = "sort_rank") -> DataFrame:
    """O1-O3 as a column: the 0-based position of each row in a total ``order``.

    Uses the distributed positional index (range-partitioned sort plus
    per-partition offsets), never a single-task global ``row_number``.
    Jobs that only need sorted output use ``orderBy`` before a write.
    """
    from ..sources.io import positional_id
    return positional_id(df, _order(order), rank_col)


def sort_source_volume(df: DataFrame) -> DataFrame:
    """O1: source asc, actual_volume desc (nulls last), input order."""
    return df.orderBy(F.col("source").asc(), F.col("actual_volume").desc_nulls_last(), F.col("ord"))


def global_limit(df: DataFrame, n: int | None, order: Iterable) -> DataFrame:
    """First n rows in ``order`` (TakeOrderedAndProject); None = no cap."""
    if n is None:
        return df
    return df.orderBy(*_order(order)).limit(n)


def prefix_sample(df: DataFrame, n: int, order_col: str = "ord") -> DataFrame:
    """The first n rows by input position, which need not be dense (a top-n, merged from each task's)."""
    return df if not n or n <= 0 else df.orderBy(order_col).limit(n)


def hash_key(seed: int, c) -> Column:
    """md5 of ``'{seed}:{value}'`` -- deterministic and engine-portable."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_sample(df: DataFrame, n: int = 10, seed: int = 42, key: str = "ord") -> DataFrame:
    """N rows without replacement, chosen by seeded hash order."""
    return df.orderBy(hash_key(seed, key), F.col(key)).limit(n)
