"""Fixture views derived from the driver tables (see FIXTURES.md).

Each view exists twice: as a DataFrame builder (what ``queries()`` runs)
and as a portable SQL CTE (what ``oracle_sql()`` inlines for DuckDB).
The builders read only the columns they need, so the Parquet scan is
pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched candidates: ord, source, src_lang, target, tgt_lang, volume, actual_volume."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    m8 = k % 8
    brand, ptype, name = F.col("p_brand"), F.col("p_type"), F.col("p_name")
    target = (
        F.when(m8 == 0, F.concat(F.upper(brand), F.lit(".")))
        .when(m8 == 1, F.concat(F.lit("  "), F.lower(brand), F.lit("?! ")))
        .when(m8 == 2, F.concat(brand, F.lit("  "), ptype))
        .when(m8 == 3, F.lit("webs"))
        .when(m8 == 4, F.lit("x"))
        .when(m8 == 5, F.concat_ws(" ", ptype, brand, name, name, name, name, name))
        .when(m8 == 6, F.concat(ptype, F.lit(" "), brand))
        .otherwise(brand)
    )
    m3 = k % 3
    tgt_lang = F.when(m3 == 0, "de_DE").when(m3 == 1, "nl_XX").otherwise("fr_XX")
    return p.select(
        k.alias("ord"),
        F.concat(name, F.lit(" "), F.lower(ptype)).alias("source"),
        F.lit("en_XX").alias("src_lang"),
        target.alias("target"),
        tgt_lang.alias("tgt_lang"),
        (F.col("p_size") * 10).cast("long").alias("volume"),
        F.when(k % 11 == 0, F.lit(None).cast("long"))
        .otherwise((k * 7919) % 200000).cast("long").alias("actual_volume"),
    )


def kw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
    return p.select(
        F.col("p_partkey").alias("ID"),
        F.col("p_name").alias("Keyword"),
        (F.col("p_size") * 10).cast("long").alias("Volume"),
        F.col("p_type").alias("SERP Features"),
        F.col("p_brand").alias("Intents"),
    )


def kw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_size")
    return p.groupBy("p_name").agg((F.max("p_size") * 10).cast("long").alias("volume")).select(
        F.col("p_name").alias("source"),
        F.lit("en_XX").alias("src_lang"),
        F.when(F.length("p_name") % 2 == 0, "de_DE").otherwise("nl_XX").alias("tgt_lang"),
        "volume",
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline scorer table: (source, target, cand_rank); padded/repeated targets."""
    from pyspark.sql import Window
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    return p.select(
        F.col("p_name").alias("source"),
        F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("target"),
        F.row_number().over(w).cast("long").alias("cand_rank"),
    )


def lang_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with repeated rows and missing target languages."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    p = p.unionByName(p.where("p_partkey % 5 = 0"))
    k = F.col("p_partkey")
    return p.select(F.col("p_name").alias("source"), F.lit("en_XX").alias("src_lang"),
                    F.when(k % 7 != 0, F.when(k % 2 == 0, "de_DE").otherwise("nl_XX")).alias("tgt_lang"),
                    (F.col("p_size") * 10).cast("long").alias("volume"))


def lang_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer table whose targets depend on the language pair."""
    from pyspark.sql import Window
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    p = p.withColumn("tgt_lang", F.when(F.col("p_partkey") % 2 == 0, "de_DE").otherwise("nl_XX"))
    w = Window.partitionBy("p_name", "tgt_lang").orderBy("p_partkey")
    return p.select(F.col("p_name").alias("source"), F.lit("en_XX").alias("src_lang"), "tgt_lang",
                    F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "), F.col("tgt_lang")).alias("target"),
                    F.row_number().over(w).cast("long").alias("cand_rank"))


def mt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, prediction, system, comet_score_segment.

    User turn joined to the next assistant turn on the unique key
    (conv_id, turn): no hot key even if one conversation is huge.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("next_turn"), F.col("turn").alias("u_turn"),
        F.col("text").alias("source"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("target"))
    j = u.join(a, ["conv_id", "next_turn"], "inner")
    cid, turn, tgt = F.col("conv_id"), F.col("u_turn"), F.col("target")
    m3 = cid % 3
    pred = (F.when(m3 == 0, tgt)
            .when(m3 == 1, F.replace(tgt, F.lit(" la "), F.lit(" le ")))
            .otherwise(F.lower(tgt)))
    return j.select(
        (cid * 1000 + turn).alias("id"),
        "source",
        "target",
        pred.alias("prediction"),
        F.when(cid % 2 == 0, "sysA").otherwise("sysB").alias("system"),
        (((cid * 31 + turn) % 100) / F.lit(100.0)).alias("comet_score_segment"),
    )


# ---- SQL forms (DuckDB) ---------------------------------------------------

KW_SQL = """kw as (
  select p_partkey as ord, concat(p_name,' ',lower(p_type)) as source, 'en_XX' as src_lang,
    case p_partkey % 8
      when 0 then concat(upper(p_brand),'.')
      when 1 then concat('  ',lower(p_brand),'?! ')
      when 2 then concat(p_brand,'  ',p_type)
      when 3 then 'webs'
      when 4 then 'x'
      when 5 then concat(p_type,' ',p_brand,' ',p_name,' ',p_name,' ',p_name,' ',p_name,' ',p_name)
      when 6 then concat(p_type,' ',p_brand)
      else p_brand end as target,
    case p_partkey % 3 when 0 then 'de_DE' when 1 then 'nl_XX' else 'fr_XX' end as tgt_lang,
    cast(p_size*10 as bigint) as volume,
    cast(case when p_partkey % 11 = 0 then null else (p_partkey*7919) % 200000 end as bigint) as actual_volume
  from part)"""

KW_EXPORT_SQL = """kw_export as (
  select p_partkey as "ID", p_name as "Keyword", cast(p_size*10 as bigint) as "Volume",
         p_type as "SERP Features", p_brand as "Intents" from part)"""

KW_QUERY_SQL = """kw_query as (
  select p_name as source, 'en_XX' as src_lang,
    case when length(p_name) % 2 = 0 then 'de_DE' else 'nl_XX' end as tgt_lang,
    cast(max(p_size)*10 as bigint) as volume from part group by p_name)"""

LEXICON_SQL = """lexicon as (
  select p_name as source, concat(' ', p_brand, ' ') as target,
    cast(row_number() over (partition by p_name order by p_partkey) as bigint) as cand_rank from part)"""

LANG_SQL = """lang_query as (
  select p_name as source, 'en_XX' as src_lang, case when p_partkey % 7 = 0 then null when p_partkey % 2 = 0
    then 'de_DE' else 'nl_XX' end as tgt_lang, cast(p_size*10 as bigint) as volume
  from (select * from part union all select * from part where p_partkey % 5 = 0)),
lang_lexicon as (
  select p_name as source, 'en_XX' as src_lang, l as tgt_lang, concat(' ', p_brand, ' ', l) as target,
    cast(row_number() over (partition by p_name, l order by p_partkey) as bigint) as cand_rank
  from (select *, case when p_partkey % 2 = 0 then 'de_DE' else 'nl_XX' end as l from part))"""

MT_SQL = """mt as (
  select u.conv_id*1000+u.turn as id, u.text as source, a.text as target,
    case u.conv_id % 3 when 0 then a.text
         when 1 then replace(a.text,' la ',' le ') else lower(a.text) end as prediction,
    case u.conv_id % 2 when 0 then 'sysA' else 'sysB' end as system,
    ((u.conv_id*31+u.turn) % 100)/cast(100 as double) as comet_score_segment
  from conversations u join conversations a on u.conv_id=a.conv_id and a.turn=u.turn+1
  where u.role='user' and a.role='assistant')"""
