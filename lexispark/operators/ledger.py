"""Extensions implied by the data: enrichment, result ledger, audits."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T

#: Columns of result files that are not text.
NUMERIC = {"id": "long", "comet_score_system": "double", "comet_score_segment": "double"}


def volume_enrich(cands: DataFrame, keywords: DataFrame, term: str = "term", lang: str = "lang",
                  volume: str = "volume", on_term: str = "target_norm",
                  on_lang: str = "tgt_lang") -> DataFrame:
    """Candidates LEFT JOIN keyword volumes on (normalised target, language).

    The keyword side is pre-aggregated to one row per key (max volume,
    map-side partial), so the join is many-to-one; AQE broadcasts it when
    the aggregate turns out small and splits skewed candidate partitions
    otherwise.
    """
    kv = keywords.groupBy(F.col(term).alias(on_term), F.col(lang).alias(on_lang)) \
                 .agg(F.max(volume).alias("actual_volume"))
    return cands.join(kv, [on_term, on_lang], "left")


def keyword_preservation(df: DataFrame, group: Sequence[str] = ("system",),
                         pred: str = "prediction", target: str = "target",
                         source: str = "source") -> DataFrame:
    """Exact-match and copied-source rates on normalised text."""
    p = T.normalize_text(pred)
    return df.groupBy(*group).agg(
        F.avg(F.when(p == T.normalize_text(target), 1.0).otherwise(0.0)).alias("match_rate"),
        F.avg(F.when(p == T.normalize_text(source), 1.0).otherwise(0.0)).alias("copy_rate"),
        F.count(F.lit(1)).alias("n"))


def file_headers(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(path, first line) of each file under ``paths`` that has a line, by path; one job, one row a file to the driver."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at")).where("block = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header")).collect()
    return sorted((unquote(r["path"]), r["header"]) for r in first)


def read_result_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union result CSVs of drifted layouts by name; ``input`` -> ``source``.

    One job finds the header of every file, and files of one layout share one
    scan with string columns, ``id`` and scores cast afterwards, so the number
    of jobs does not depend on that of the files. The columns
    ``pair`` and ``variant`` come from the file's name
    (``{prefix}_{xx}_{yy}[_{variant}]_eval.csv``), ``family`` from the folder
    above it or above its pair folder, ``folder_pair`` from the latter (empty
    without one): it differs from ``pair`` where a file is misfiled.
    """
    from ..sources import io
    layouts: dict[tuple[str, ...], list[str]] = {}
    if paths:
        for path, header in file_headers(spark, paths):
            layouts.setdefault(tuple(next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]))), []).append(path)
    out = None
    for cols, files in layouts.items():
        schema = T_.StructType([T_.StructField(c, T_.StringType()) for c in cols])
        d = io.harmonise_pair(io.read_csv(spark, files, schema, with_file=True, with_ord=False, multiline=True))
        d = d.select(*[F.col(f"`{c}`").cast(NUMERIC.get(c, "string")).alias(c) for c in d.columns])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no result files are given")
    fp = F.col("file_path")
    name = r"/[^/]+?_([a-z]{2}_[a-z]{2})(?:_([^/]+))?_eval\.csv"
    return (out.withColumn("family", F.regexp_extract(fp, r"([^/]+)/(?:[a-z]{2}_[a-z]{2}/)?[^/]+_eval\.csv", 1))
               .withColumn("pair", F.regexp_extract(fp, name, 1))
               .withColumn("folder_pair", F.regexp_extract(fp, r"/([a-z]{2}_[a-z]{2})/[^/]+_eval\.csv", 1))
               .withColumn("variant", F.coalesce(F.regexp_extract(fp, name, 2), F.lit(""))))


def fingerprint(c) -> F.Column:
    """Order-independent per-row hash contribution: 60 bits of md5 as a decimal, null apart from the empty text."""
    c = T._c(c)
    h = F.md5(F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c)))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(20,0)")


def run_set_audit(ledger: DataFrame, file_col: str = "run", pair_col: str | None = None) -> DataFrame:
    """Per run: rows, prediction/source fingerprints (decimals as text), missing predictions,
    and the first other run with identical predictions (a duplicate run): the
    smallest or second smallest of its fingerprint, without pairing runs.
    With ``pair_col``, ``wrong_pair`` tells that runs of another language pair
    have the same source texts, so one of them holds the wrong pair's input."""
    pair = [F.min(pair_col).alias("_pair")] if pair_col else []
    per = ledger.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(fingerprint("prediction")).cast("string").alias("pred_fp"),
        F.sum(fingerprint("source")).cast("string").alias("src_fp"), *pair,
        F.count_if(F.col("prediction").isNull() | (T.py_strip("prediction") == "")).alias("n_missing"))
    if pair_col:
        pairs = per.groupBy("src_fp", "n_rows").agg((F.min("_pair") != F.max("_pair")).alias("wrong_pair"))
        per = per.join(pairs, ["src_fp", "n_rows"]).drop("_pair")
    same = ["pred_fp", "n_rows"]
    first = per.groupBy(*same).agg(F.min(file_col).alias("_first"))
    known = per.join(first, same)
    second = known.where(F.col(file_col) != F.col("_first")).groupBy(*same).agg(F.min(file_col).alias("_second"))
    other = F.when(F.col(file_col) != F.col("_first"), F.col("_first")).otherwise(F.col("_second"))
    return known.join(second, same, "left").select(*per.columns, other.alias("duplicate_of"))
