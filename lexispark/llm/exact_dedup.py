"""Exact duplicates: 128-bit content hash, smallest id kept, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, parted, stored, text_of

#: Runs that differ from one plain space; replacing only these leaves the same text.
_RUNS = r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]"


def normalised(col: str) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(text_of(col), _RUNS, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(df: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[Column], Column]) -> DataFrame:
    text = normalised(text_col)
    return df.select(F.col(id_col).alias("doc_id"), hash_fn(text).alias("content_hash"),
                     F.sha2(text, 256).alias("text_sha256"), text.alias("norm"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per group of byte-equal normalised texts: content_hash, text_sha256, keep_id, group_size.

    The aggregation key is (content hash, bytes): rows whose hashes agree but
    whose bytes differ fall into separate groups. Copies collapse before the
    shuffle, so a text that a third of all rows share costs one row a task.
    """
    return (_keyed(df, id_col, text_col, hash_fn).groupBy("content_hash", "norm")
            .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("content_hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. A null id is never the kept one while its
    group has another id; a group of null ids only has keep_id null and keeps
    its rows. Rows that repeat an id are one document and share its decision.
    An empty table gives an empty result. Groups are found again by content
    hash and SHA-256 together; the join has one small row per group, and a hot
    group is split by adaptive skew handling.
    """
    rows = _keyed(df, id_col, text_col, hash_fn).drop("norm")
    groups = exact_groups(df, id_col, text_col, hash_fn)
    return rows.join(groups, ["content_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns as they were, whatever their names.

    Content hashes alone tell which rows have a copy; only these rows'
    texts are shuffled, to compare bytes and to find the smallest id. Rows
    with a null id are always compared. What stays is what ``exact_dedup`` keeps.
    """
    hashed = stored(df.select(F.col(id_col).alias("doc_id"), content_hash(normalised(text_col)).alias("h")), "exact")
    several = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    maybe, alone = parted(df, id_col, hashed.where("doc_id IS NOT NULL").join(several, "h", "left_semi").select("doc_id"))
    h, s, k = (fresh(df, n) for n in ("__h", "__s", "__k"))
    groups = exact_groups(maybe, id_col, text_col).select(
        F.col("content_hash").alias(h), F.col("text_sha256").alias(s), F.col("keep_id").alias(k))
    text = normalised(text_col)
    cond = ((content_hash(text) == F.col(h)) & (F.sha2(text, 256) == F.col(s)) & F.col(id_col).eqNullSafe(F.col(k)))
    return alone.unionByName(maybe.join(groups, cond, "left_semi"))
