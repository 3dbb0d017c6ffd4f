"""L1: keyword pairs -> clean_full / train / eval / train_upweighted.

One lazy plan; nothing is collected. Shuffles: the keep-first
de-duplication (aggregate, map-side combined) and the top-k window
(partial WindowGroupLimit before its exchange). The split adds a small
aggregate over distinct sources plus a one-row broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, rank, split
from ..session import stored

REQUIRED = ("source", "src_lang", "target", "tgt_lang", "actual_volume")


@dataclass(frozen=True)
class PrepConfig:
    topk_per_source: int = 1
    min_target_sv: float = 1
    min_chars: int = 2
    max_chars: int = 60
    train_frac: float = 0.9
    seed: int = 42
    missing: str = "null"   # or "pandas": missing text becomes the string 'nan'


def annotate(df: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Row-local stage: normalise and flag each filter (no row dropped yet)."""
    clean.require_columns(df, REQUIRED)
    df = df.withColumn("target_norm", T.normalize_text("target", cfg.missing))
    vol_ok = T.null_to_zero("actual_volume") >= F.lit(float(cfg.min_target_sv))
    src = T.py_strip(T.cast_text("source", cfg.missing))
    tgt = T.py_strip(T.cast_text("target", cfg.missing))
    len_ok = (F.length(src).between(cfg.min_chars, cfg.max_chars)
              & F.length(tgt).between(cfg.min_chars, cfg.max_chars))
    return (df.withColumn("source", src).withColumn("target", tgt)
              .withColumn("_vol_ok", vol_ok)
              .withColumn("_len_ok", F.coalesce(len_ok, F.lit(False)))
              .withColumn("_valid", clean.is_valid_candidate("target_norm")))


def filtered(df: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """F1 -> C1 -> F2 -> F3 as one codegen stage."""
    a = annotate(df, cfg)
    return a.where(F.col("_vol_ok") & F.col("_len_ok") & F.col("_valid")) \
        .drop("_vol_ok", "_len_ok", "_valid")


def clean_full(df: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """The L1 result before splitting: filters, keep-first dedup, top-k per source."""
    f = filtered(df, cfg)
    d = clean.dedup_keep_first(f, ["source", "target_norm"], "ord")
    return rank.topk_per_source(d, cfg.topk_per_source, "actual_volume", "source", "ord")


def with_split(full: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """X1 on unique sources: adds ``split`` in {'train','eval'}."""
    return split.group_split(full, "source", cfg.train_frac, cfg.seed)


def training_pairs(labelled: DataFrame, which: str) -> DataFrame:
    """``source`` -> ``input``; project (input, target)."""
    return labelled.where(F.col("split") == which).select(
        F.col("source").alias("input"), "target")


def upweighted_train(labelled: DataFrame) -> DataFrame:
    """X3 + X4 over the train rows, projected to (input, target)."""
    t = labelled.where(F.col("split") == "train").withColumn(
        "sv_bucket", split.volume_bucket("actual_volume"))
    return split.upweight(t, "sv_bucket").select(F.col("source").alias("input"), "target")


def stage_funnel(df: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """K5: (step, stage, rows) for every stage, from one scan and one run of L1.

    The aggregate that removes duplicates counts what falls before it too: a
    row that a filter drops goes, without its text, to that filter's own
    group, combined on the map side. Its result is written once; the counts up
    to the duplicates are sums over it, the later ones over the split result.
    (Counters of a running job could count a task twice that is run again.)
    """
    clean.require_columns(df, REQUIRED)
    marked = annotate(df, cfg)
    fell = F.when(~F.col("_vol_ok"), 1).when(~F.col("_len_ok"), 2).when(~F.col("_valid"), 3).otherwise(0).alias("_fell")
    keys = ["source", "target_norm"]
    rest = [c for c in marked.columns if c not in (*keys, "ord", "_vol_ok", "_len_ok", "_valid")]
    held = lambda c: F.when(F.col("_fell") == 0, F.col(c))
    marked = marked.select(fell, "ord", *keys, *rest)
    first = F.min(F.struct(*[held(c).alias(c) for c in ("ord", *rest)])).alias("_first")
    groups = stored(marked.groupBy("_fell", *[held(c).alias(c) for c in keys]).agg(first, F.count(F.lit(1)).alias("_n")), "funnel")
    kept = groups.where("_fell = 0").select(*keys, "_first.*")
    passed = lambda *by: F.coalesce(F.sum(F.when(~F.col("_fell").isin(*by), F.col("_n"))), F.lit(0)).alias("rows")
    pre = groups.agg(F.array(passed(-1), passed(1), passed(1, 2), passed(1, 2, 3), F.count_if(F.col("_fell") == 0)).alias("rows"))
    lab = with_split(rank.topk_per_source(kept, cfg.topk_per_source), cfg)
    post = lab.agg(F.array(F.count(F.lit(1)), F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "eval")).alias("rows"))
    stages = ["input", "min_volume", "length_band", "valid_candidate",
              "dedup_keep_first", "clean_full", "train", "eval"]
    names = F.array(*[F.lit(s) for s in stages])
    out = [d.select(F.posexplode("rows").alias("at", "rows")).select((F.col("at") + F.lit(start)).cast("int").alias("step"), "rows")
           for d, start in ((pre, 0), (post, 5))]
    return out[0].unionByName(out[1]).select("step", F.element_at(names, F.col("step") + 1).alias("stage"), F.col("rows").cast("long").alias("rows"))


def write_outputs(df: DataFrame, out_dir: str, cfg: PrepConfig = PrepConfig(),
                  make_upweighted: bool = False, fmt: str = "csv") -> None:
    """Sinks K1/K2/K4: clean_full (the input's columns and ``target_norm``,
    without ``ord``), then train/eval in one partitioned write.

    All are in O1's order: source, then volume falling, then input order. The
    labelled frame is written once (partitioned by split) and re-read, so
    train/eval/upweighted never recompute the dedup/top-k shuffles.
    """
    from ..sources import io
    full = clean_full(df, cfg)
    labelled = with_split(full, cfg)
    base = out_dir.rstrip("/")
    io.write_table(labelled, f"{base}/_labelled", fmt="parquet", partition_by=["split"])
    lab = df.sparkSession.read.schema(labelled.schema).parquet(f"{base}/_labelled")
    order = [F.col("source"), F.col("actual_volume").desc_nulls_last(), F.col("ord")]
    io.write_table(lab.orderBy(*order).select(*[c for c in full.columns if c != "ord"]), f"{base}/clean_full", fmt=fmt)
    io.write_table(lab.orderBy("split", *order).select(F.col("source").alias("input"), "target", "split"),
                   f"{base}/pairs", fmt=fmt, partition_by=["split"])
    if make_upweighted:
        io.write_table(upweighted_train(lab.orderBy(*order)), f"{base}/train_upweighted", fmt=fmt)
