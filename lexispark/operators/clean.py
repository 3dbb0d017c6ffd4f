"""Filters, contracts and de-duplication.

Filters are row-local column predicates: they fuse into one codegen
stage and push into the Parquet scan where the predicate allows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Target strings rejected as candidates.
STOP_TARGETS = ["news news", "webs", "nltv"]


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P5: raise at build time, listing every missing column."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise KeyError(f"the table lacks {', '.join(missing)}")
    return df


def min_volume(df: DataFrame, col: str = "actual_volume", min_sv: float = 1) -> DataFrame:
    """keep ``coalesce(col, 0) >= min_sv`` (a non-numeric string raises under ANSI)."""
    return df.where(T.null_to_zero(col) >= F.lit(float(min_sv)))


def length_band(df: DataFrame, cols: Iterable[str] = ("source", "target"),
                min_chars: int = 2, max_chars: int = 60) -> DataFrame:
    """every column's length (code points) in [min_chars, max_chars]."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.length(c).between(min_chars, max_chars)
    return df.where(cond)


def is_valid_candidate(c) -> Column:
    """F3 predicate: string; stripped length >= 2; not a stop target; no double space."""
    t = T.py_strip(T._c(c))
    return (F.coalesce(
        (F.length(t) >= 2) & ~t.isin(STOP_TARGETS) & ~t.contains("  "), F.lit(False)))


def valid_candidate(df: DataFrame, col: str = "target_norm") -> DataFrame:
    return df.where(is_valid_candidate(col))


def drop_missing(df: DataFrame, cols: Iterable[str] = ("source",)) -> DataFrame:
    """F4."""
    return df.dropna(subset=list(cols))


def drop_header_echo(df: DataFrame, col: str = "source") -> DataFrame:
    """a repeated header row, ``lower(col) == col`` name (not stripped)."""
    return df.where(F.lower(F.col(col)) != F.lit(col))


def drop_blank(df: DataFrame, col: str = "source") -> DataFrame:
    """blank after strip."""
    return df.where(T.py_strip(col) != "")


def clean_queries(df: DataFrame, col: str = "source") -> DataFrame:
    """F4 -> cast -> F5 -> F6, as before candidate generation."""
    df = drop_missing(df, [col]).withColumn(col, F.col(col).cast("string"))
    return drop_blank(drop_header_echo(df, col), col)


def keep_in(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """F8: membership in a literal list."""
    return df.where(F.col(col).isin(list(values)))


def positive(df: DataFrame, col: str = "SV") -> DataFrame:
    """positive, non-missing (null-rejecting)."""
    return df.where(F.col(col) > 0)


def dedup_keep_first(df: DataFrame, keys: Iterable[str], order_col: str = "ord") -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each key; null keys equal.

    Built as ``min(struct(order_col, ...))`` per key rather than a window:
    the aggregate combines map-side, so a key holding a third of all rows
    is collapsed before the shuffle instead of landing in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    first = F.min(F.struct(F.col(order_col), *[F.col(c) for c in rest])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [order_col] + rest]) \
        .select(*df.columns)


def nbest_distinct(c) -> Column:
    """Strip every candidate, drop empty ones, keep the first of repeats."""
    stripped = F.transform(T._c(c), lambda x: T.py_strip(x))
    return F.array_distinct(F.filter(stripped, lambda x: x != ""))
