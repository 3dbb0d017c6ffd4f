"""L1 queries: keyword pairs -> clean, de-duplicated, top-k, split, up-weighted."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import text as T
from ..operators import clean, split
from ..sources import fixtures as fx
from . import prepare as P
from .catalog import register

K = 2                       # top-k used by the registered L1 queries
CFG = P.PrepConfig(topk_per_source=K)
L1_COLS = "ord, source, src_lang, target, tgt_lang, volume, actual_volume, target_norm"


@register("topk_per_source", O.l1(K) + f"select {L1_COLS} from l1_full")
def q_topk_per_source(spark, sf):
    return P.clean_full(fx.kw(spark, sf), CFG)


@register("dedup_keep_first", O.with_(O.KW_SQL, O.l1_filtered(), O.L1_DEDUP)
          + f"select {L1_COLS} from l1_dedup")
def q_dedup_keep_first(spark, sf):
    f = P.filtered(fx.kw(spark, sf), CFG)
    return clean.dedup_keep_first(f, ["source", "target_norm"], "ord")


@register("min_volume", O.with_(O.KW_SQL)
          + "select ord, actual_volume from kw where coalesce(cast(actual_volume as double), 0) >= 1.0")
def q_min_volume(spark, sf):
    return clean.min_volume(fx.kw(spark, sf), "actual_volume", 1).select("ord", "actual_volume")


@register("length_band", O.with_(O.KW_SQL)
          + f"select ord, {O.strip('source')} as source, {O.strip('target')} as target from kw "
            f"where length({O.strip('source')}) between 2 and 60 "
            f"and length({O.strip('target')}) between 2 and 60")
def q_length_band(spark, sf):
    df = fx.kw(spark, sf).select("ord", T.py_strip("source").alias("source"),
                                 T.py_strip("target").alias("target"))
    return clean.length_band(df, ["source", "target"], 2, 60)


@register("valid_candidate", O.with_(O.KW_SQL)
          + f"select ord, {O.norm('target')} as target_norm, {O.valid(O.norm('target'))} as is_valid from kw")
def q_valid_candidate(spark, sf):
    df = fx.kw(spark, sf).select("ord", T.normalize_text("target").alias("target_norm"))
    return df.withColumn("is_valid", clean.is_valid_candidate("target_norm"))


@register("normalize_text", O.with_(O.KW_SQL)
          + f"select ord, {O.norm('target')} as target_norm, {O.norm('source')} as source_norm from kw")
def q_normalize_text(spark, sf):
    return fx.kw(spark, sf).select("ord", T.normalize_text("target").alias("target_norm"),
                                   T.normalize_text("source").alias("source_norm"))


_SPLIT_SQL = O.with_(O.KW_SQL, O.l1_filtered(), O.L1_DEDUP, O.l1_topk(K),
                     O.group_split_cte("l1_full", "source", 0.9, 42, "lab"))


@register("group_split", _SPLIT_SQL + "select ord, source, split from lab")
def q_group_split(spark, sf):
    return P.with_split(P.clean_full(fx.kw(spark, sf), CFG), CFG).select("ord", "source", "split")


@register("semi_join_train", _SPLIT_SQL
          + f"select {L1_COLS} from l1_full where source in (select source from lab where split = 'train')")
def q_semi_join_train(spark, sf):
    lab = P.with_split(P.clean_full(fx.kw(spark, sf), CFG), CFG)  # stored by the split, so L1 runs once
    train_src = lab.where(F.col("split") == "train").select("source").distinct()
    return split.semi_join(lab.drop("split"), train_src, "source")


@register("anti_join_eval", _SPLIT_SQL
          + f"select {L1_COLS} from l1_full where source not in (select source from lab where split = 'train')")
def q_anti_join_eval(spark, sf):
    lab = P.with_split(P.clean_full(fx.kw(spark, sf), CFG), CFG)  # stored by the split, so L1 runs once
    train_src = lab.where(F.col("split") == "train").select("source").distinct()
    return split.anti_join(lab.drop("split"), train_src, "source")


_BUCKET_SQL = """case when actual_volume is null or actual_volume <= -1 then null
  when actual_volume <= 100 then 1 when actual_volume <= 1000 then 2
  when actual_volume <= 10000 then 3 when actual_volume <= 100000 then 4 else 5 end"""


@register("volume_bucket", O.with_(O.KW_SQL)
          + f"select ord, actual_volume, cast({_BUCKET_SQL} as integer) as sv_bucket from kw")
def q_volume_bucket(spark, sf):
    return fx.kw(spark, sf).select("ord", "actual_volume",
                                   split.volume_bucket("actual_volume").alias("sv_bucket"))


@register("upweight_train", _SPLIT_SQL
          + f"select source as input, target from lab, range(cast({_BUCKET_SQL} as bigint)) r "
            "where split = 'train'")
def q_upweight_train(spark, sf):
    lab = P.with_split(P.clean_full(fx.kw(spark, sf), CFG), CFG)
    return P.upweighted_train(lab)


@register("stage_funnel", _SPLIT_SQL + f"""
select * from (values
  (0, 'input', (select count(*) from kw)),
  (1, 'min_volume', (select count(*) from kw where coalesce(cast(actual_volume as double), 0) >= 1.0)),
  (2, 'length_band', (select count(*) from kw where coalesce(cast(actual_volume as double), 0) >= 1.0
      and coalesce(length({O.strip('source')}) between 2 and 60 and length({O.strip('target')}) between 2 and 60, false))),
  (3, 'valid_candidate', (select count(*) from l1_filtered)),
  (4, 'dedup_keep_first', (select count(*) from l1_dedup)),
  (5, 'clean_full', (select count(*) from l1_full)),
  (6, 'train', (select count(*) from lab where split = 'train')),
  (7, 'eval', (select count(*) from lab where split = 'eval'))
) t(step, stage, rows)""")
def q_stage_funnel(spark, sf):
    return P.stage_funnel(fx.kw(spark, sf), CFG)


@register("null_to_zero", O.with_(O.KW_SQL)
          + "select ord, coalesce(cast(actual_volume as double), 0.0) as sv from kw")
def q_null_to_zero(spark, sf):
    return fx.kw(spark, sf).select("ord", T.null_to_zero("actual_volume").alias("sv"))


@register("py_strip", O.with_(O.KW_SQL)
          + f"select ord, {O.strip('target')} as stripped, length({O.strip('target')}) as n from kw")
def q_py_strip(spark, sf):
    s = T.py_strip("target")
    return fx.kw(spark, sf).select("ord", s.alias("stripped"), F.length(s).alias("n"))


@register("lower", O.with_(O.KW_SQL) + "select ord, lower(target) as lowered from kw")
def q_lower(spark, sf):
    return fx.kw(spark, sf).select("ord", T.lower("target").alias("lowered"))


@register("rstrip_punct", O.with_(O.KW_SQL)
          + "select ord, regexp_replace(target, '[.,;!?]+$', '') as trimmed from kw")
def q_rstrip_punct(spark, sf):
    return fx.kw(spark, sf).select("ord", T.rstrip_punct("target").alias("trimmed"))


@register("char_length", O.with_(O.KW_SQL)
          + "select ord, cast(length(target) as bigint) as n_chars, cast(length(source) as bigint) as n_src from kw")
def q_char_length(spark, sf):
    return fx.kw(spark, sf).select("ord", T.char_length("target").cast("long").alias("n_chars"),
                                   T.char_length("source").cast("long").alias("n_src"))


@register("contains_isin", O.with_(O.KW_SQL)
          + "select ord, contains(target, '  ') as has_double_space, "
            "tgt_lang in ('de_DE', 'nl_XX') as known_lang from kw")
def q_contains_isin(spark, sf):
    return fx.kw(spark, sf).select(
        "ord", F.col("target").contains("  ").alias("has_double_space"),
        F.col("tgt_lang").isin("de_DE", "nl_XX").alias("known_lang"))


@register("cast_text", O.with_(O.KW_SQL)
          + "select ord, coalesce(cast(actual_volume as varchar), 'nan') as sv_text from kw")
def q_cast_text(spark, sf):
    return fx.kw(spark, sf).select("ord", T.cast_text("actual_volume", "pandas").alias("sv_text"))


@register("int_floor", O.with_(O.KW_SQL)
          + "select ord, cast(floor(volume * cast(0.9 as double)) as bigint) as cut, "
            "cast(ceil(volume * cast(0.1 as double)) as bigint) as up, least(volume, 100) as capped from kw")
def q_int_floor(spark, sf):
    v = F.col("volume")
    return fx.kw(spark, sf).select(
        "ord", T.int_floor(v * F.lit(0.9)).alias("cut"), F.ceil(v * F.lit(0.1)).cast("long").alias("up"),
        F.least(v, F.lit(100).cast("long")).alias("capped"))


@register("sort_source_volume", O.l1(K)
          + "select ord, cast(row_number() over (order by source, actual_volume desc nulls last, ord) - 1 as bigint) as pos from l1_full")
def q_sort_source_volume(spark, sf):
    from ..sources import io
    full = P.clean_full(fx.kw(spark, sf), CFG)
    ordered = io.positional_id(full, [F.col("source"), F.col("actual_volume").desc_nulls_last(),
                                      F.col("ord")], "pos")
    return ordered.select("ord", "pos")


@register("valid_candidate_pandas_mode", O.with_(O.KW_SQL.replace("kw as (", "kw_all as ("),
          """kw as (select ord, case when ord % 13 = 0 then 'nan' else source end as source, src_lang,
  case when ord % 9 = 0 then 'nan' else target end as target, tgt_lang, volume, actual_volume from kw_all)""",
          O.l1_filtered(), O.L1_DEDUP, O.l1_topk(K)) + f"select {L1_COLS} from l1_full")
def q_pandas_mode(spark, sf):
    """L1 under missing='pandas': missing sources and targets become the text 'nan' and stay."""
    kw = fx.kw(spark, sf)
    holes = kw.withColumn("source", F.when(F.col("ord") % 13 != 0, F.col("source"))) \
              .withColumn("target", F.when(F.col("ord") % 9 != 0, F.col("target")))
    return P.clean_full(holes, P.PrepConfig(topk_per_source=K, missing="pandas"))


@register("distinct_sources", O.l1(K) + "select distinct source from l1_full")
def q_distinct_sources(spark, sf):
    """A3: the unique sources of the L1 result (map-side combined distinct)."""
    return P.clean_full(fx.kw(spark, sf), CFG).select("source").distinct()
