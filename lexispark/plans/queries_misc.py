"""L2 / L4 queries and the remaining projections, lookups, sorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import lang as L
from ..functions import text as T
from ..operators import bitext, clean, infer, ledger, rank, stats
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io
from . import candidates as C
from .catalog import register

# ---- L4: volume statistics --------------------------------------------------

_LONG = f"""stacked as (
  select source as term, src_lang as lang, cast(volume as varchar) as sv_text, 'source' as role from kw
  union all
  select target, tgt_lang, cast(actual_volume as varchar), 'target' from kw),
mapped as (
  select term, case lang when 'de_DE' then 'DE' when 'en_XX' then 'EN' when 'nl_XX' then 'NL' end as language,
         sv_text, role from stacked),
long as (
  select {O.strip('term')} as term, language, try_cast(sv_text as double) as SV, role from mapped
  where language in ('DE', 'NL', 'EN') and try_cast(sv_text as double) > 0),
dedup as (select role, language, term, max(SV) as SV from long group by all)"""
_L4 = O.with_(O.KW_SQL, _LONG)


def _long(spark, sf):
    return stats.long_volumes(fx.kw(spark, sf))


def _dedup(spark, sf):
    return stats.max_volume_dedup(_long(spark, sf))


@register("stack_roles", O.with_(O.KW_SQL, _LONG.split(",\nmapped")[0])
          + "select term, lang as language, sv_text as SV, role from stacked")
def q_stack_roles(spark, sf):
    return stats.stack_roles(fx.kw(spark, sf))


@register("lang_map", O.with_(O.KW_SQL)
          + "select ord, case tgt_lang when 'de_DE' then 'DE' when 'en_XX' then 'EN' "
            "when 'nl_XX' then 'NL' end as language from kw")
def q_lang_map(spark, sf):
    return fx.kw(spark, sf).select("ord", stats.map_language("tgt_lang").alias("language"))


@register("lang_membership", O.with_(O.KW_SQL)
          + "select ord, tgt_lang from kw where tgt_lang in ('de_DE', 'nl_XX')")
def q_lang_membership(spark, sf):
    return clean.keep_in(fx.kw(spark, sf), "tgt_lang", ["de_DE", "nl_XX"]).select("ord", "tgt_lang")


_COERCE_TEXT = """case ord % 6 when 0 then cast(actual_volume as varchar)
  when 1 then ' ' || cast(volume as varchar) || ' ' when 2 then cast(volume as varchar) || 'e1'
  when 3 then 'x' || cast(volume as varchar) when 4 then '1,' || cast(volume as varchar) else 'inf' end"""


@register("numeric_coerce", O.with_(O.KW_SQL)
          + f"select ord, {_COERCE_TEXT} as sv_text, try_cast({_COERCE_TEXT} as double) as sv from kw")
def q_numeric_coerce(spark, sf):
    k = F.col("ord") % 6
    v, av = F.col("volume").cast("string"), F.col("actual_volume").cast("string")
    txt = (F.when(k == 0, av).when(k == 1, F.concat(F.lit(" "), v, F.lit(" ")))
           .when(k == 2, F.concat(v, F.lit("e1"))).when(k == 3, F.concat(F.lit("x"), v))
           .when(k == 4, F.concat(F.lit("1,"), v)).otherwise(F.lit("inf")))
    return fx.kw(spark, sf).select("ord", txt.alias("sv_text"), T.numeric_coerce(txt).alias("sv"))


@register("positive_volume", _L4 + "select term, language, SV, role from long")
def q_positive_volume(spark, sf):
    return _long(spark, sf)


@register("max_volume_dedup", _L4 + "select role, language, term, SV from dedup")
def q_max_volume_dedup(spark, sf):
    return _dedup(spark, sf)


@register("sort_dedup", _L4 + "select role, language, term, cast(row_number() over "
          "(order by role, language, SV desc, term) - 1 as bigint) as pos from dedup")
def q_sort_dedup(spark, sf):
    d = _dedup(spark, sf)
    return io.positional_id(d, [F.col("role"), F.col("language"), F.col("SV").desc(), F.col("term")],
                            "pos").select("role", "language", "term", "pos")


@register("volume_summary", _L4 + "select language, count(SV) as count, min(SV) as min, "
          "quantile_cont(SV, 0.5) as median, max(SV) as max from dedup group by language")
def q_volume_summary(spark, sf):
    return stats.volume_summary(_dedup(spark, sf))


@register("violin_marks", _L4 + "select language, avg(SV) as mean, quantile_cont(SV, 0.5) as median, "
          "min(SV) as min, max(SV) as max from dedup group by language")
def q_violin_marks(spark, sf):
    return stats.violin_marks(_dedup(spark, sf))


@register("violin_density", _L4.rstrip("\n") + f""",
st as (select language, count(SV) as n, stddev_samp(SV) as sd, min(SV) as lo, max(SV) as hi
       from dedup group by language having stddev_samp(SV) > 0),
g as (select language, n, sd * pow(cast(n as double), -0.2) as bw, lo, hi, i,
             lo + i * (hi - lo) / {stats.KDE_POINTS - 1} as x from st, range({stats.KDE_POINTS}) t(i)),
vals as (select language, SV, count(*) as w from dedup group by all)
select g.language, cast(i as bigint) as i, x,
  round(sum(w * exp(-0.5 * ((x - SV) / bw) * ((x - SV) / bw))) / (n * bw * sqrt(2 * pi())) * (hi - lo), 6)
    as density_scaled
from g join vals using (language) group by g.language, i, x, n, bw, lo, hi""")
def q_violin_density(spark, sf):
    return stats.violin_density(_dedup(spark, sf))


@register("box_stats", _L4.rstrip("\n") + """,
q as (select language, quantile_cont(SV, 0.25) as q1, quantile_cont(SV, 0.5) as median,
             quantile_cont(SV, 0.75) as q3 from dedup group by language),
w as (select q.language, q1, median, q3,
             min(case when SV >= q1 - 1.5 * (q3 - q1) then SV end) as wl,
             max(case when SV <= q3 + 1.5 * (q3 - q1) then SV end) as wh
      from dedup join q using (language) group by q.language, q1, median, q3)
select language, q1, median, q3,
  case when wl is null or wl > q1 then q1 else wl end as whislo,
  case when wh is null or wh < q3 then q3 else wh end as whishi from w""")
def q_box_stats(spark, sf):
    return stats.box_stats(_dedup(spark, sf))


# ---- languages ----------------------------------------------------------------

_PAIRS = """pairs as (
  select distinct p from (
    select 'en-' || substr(tgt_lang, 1, 2) as p from kw
    union all select substr(tgt_lang, 1, 2) || '-en' from kw
    union all select 'en' || substr(tgt_lang, 1, 2) from kw
    union all select case substr(tgt_lang, 1, 2) when 'de' then 'deu_Latn' when 'nl' then 'nld_Latn'
                     else 'fra_Latn' end || '-eng_Latn' from kw
    union all select 'eng_Latn-' || substr(tgt_lang, 1, 2) from kw))"""


def _pairs(spark, sf):
    kw = fx.kw(spark, sf)
    two = F.substring("tgt_lang", 1, 2)
    longc = F.when(two == "de", "deu_Latn").when(two == "nl", "nld_Latn").otherwise("fra_Latn")
    forms = F.array(F.concat(F.lit("en-"), two), F.concat(two, F.lit("-en")), F.concat(F.lit("en"), two),
                    F.concat(longc, F.lit("-eng_Latn")), F.concat(F.lit("eng_Latn-"), two))
    return kw.select(F.explode(forms).alias("p")).distinct()


_FL = "case {x} when 'de' then 'deu_Latn' when 'en' then 'eng_Latn' when 'nl' then 'nld_Latn' end"


@register("resolve_lang_pair", O.with_(O.KW_SQL, _PAIRS) + f"""
select p as pair,
  case when strpos(p, '-') = 0 then null
       when strpos(split_part(p, '-', 1), '_') > 0 and strpos(substr(p, strpos(p, '-') + 1), '_') > 0
         then split_part(p, '-', 1)
       when {_FL.format(x="split_part(p, '-', 1)")} is null or {_FL.format(x="substr(p, strpos(p, '-') + 1)")} is null
         then null
       else {_FL.format(x="split_part(p, '-', 1)")} end as src,
  case when strpos(p, '-') = 0 then null
       when strpos(split_part(p, '-', 1), '_') > 0 and strpos(substr(p, strpos(p, '-') + 1), '_') > 0
         then substr(p, strpos(p, '-') + 1)
       when {_FL.format(x="split_part(p, '-', 1)")} is null or {_FL.format(x="substr(p, strpos(p, '-') + 1)")} is null
         then null
       else {_FL.format(x="substr(p, strpos(p, '-') + 1)")} end as tgt
from pairs""")
def q_resolve_lang_pair(spark, sf):
    r = L.resolve_lang_pair("p", on_error="null")
    return _pairs(spark, sf).select(F.col("p").alias("pair"), r["src"].alias("src"), r["tgt"].alias("tgt"))


@register("family_lang_route", O.with_(O.KW_SQL) + f"""
select ord, family, flores,
  case family when 'mbart50' then case flores when 'deu_Latn' then 'de_DE' when 'eng_Latn' then 'en_XX'
                                              when 'nld_Latn' then 'nl_XX' end
              when 'm2m100' then case flores when 'deu_Latn' then 'de' when 'eng_Latn' then 'en'
                                             when 'nld_Latn' then 'nl' end end as code
from (select ord, case ord % 3 when 0 then 'mbart50' when 1 then 'm2m100' else 'helsinki' end as family,
             {_FL.format(x='substr(tgt_lang, 1, 2)')} as flores from kw)""")
def q_family_lang_route(spark, sf):
    fam = F.array(*[F.lit(f) for f in L.FAMILIES])[(F.col("ord") % 3).cast("int")]
    fl = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.FLORES_CODE.items() for x in kv]),
                          F.substring("tgt_lang", 1, 2))
    d = fx.kw(spark, sf).select("ord", fam.alias("family"), fl.alias("flores"))
    return d.withColumn("code", L.family_code("family", "flores", on_error="null"))


_PAIR_CODE = """case family when 'mbart50' then case {x} when 'deu_Latn' then 'de_DE' when 'eng_Latn' then 'en_XX' when 'nld_Latn' then 'nl_XX' end
  when 'm2m100' then case {x} when 'deu_Latn' then 'de' when 'eng_Latn' then 'en' when 'nld_Latn' then 'nl' end end"""


@register("family_pair_route", O.with_(O.KW_SQL) + f""", r as (
select ord, case ord % 3 when 0 then 'mbart50' when 1 then 'm2m100' else 'helsinki' end as family,
  {_FL.format(x='substr(src_lang, 1, 2)')} as a, {_FL.format(x='substr(tgt_lang, 1, 2)')} as b from kw),
c as (select *, {_PAIR_CODE.format(x='a')} as ca, {_PAIR_CODE.format(x='b')} as cb from r)
select ord, family, case when ca is not null and cb is not null then ca end as src, case when ca is not null and cb is not null then cb end as tgt from c""")
def q_family_pair_route(spark, sf):
    """Both languages' codes of a pair: where one is missing, neither is given."""
    fam = F.array(*[F.lit(f) for f in L.FAMILIES])[(F.col("ord") % 3).cast("int")]
    short = F.create_map(*[F.lit(x) for kv in L.FLORES_CODE.items() for x in kv])
    code = {c: F.try_element_at(short, F.substring(c, 1, 2)) for c in ("src_lang", "tgt_lang")}
    pair = L.family_pair(fam, code["src_lang"], code["tgt_lang"], on_error="null")
    return fx.kw(spark, sf).select("ord", fam.alias("family"), pair["src"].alias("src"), pair["tgt"].alias("tgt"))


# ---- L2: candidates ---------------------------------------------------------------

_NBEST = f"""q as (select * from kw_query where source is not null and lower(source) <> 'source'
                 and {O.strip('source')} <> ''),
c as (select source, target, cand_rank from lexicon
      qualify row_number() over (partition by source order by cand_rank, target) <= 5),
j as (select q.source, q.src_lang, q.tgt_lang, q.volume, {O.strip('c.target')} as target, c.cand_rank
      from q join c on q.source = c.source where {O.strip('c.target')} <> ''),
nb as (select source, src_lang, tgt_lang, volume, target, min(cand_rank) as cand_rank from j group by all)"""


@register("nbest_candidates", O.with_(O.KW_QUERY_SQL, O.LEXICON_SQL, _NBEST)
          + "select source, src_lang, tgt_lang, volume, target, cand_rank from nb")
def q_nbest_candidates(spark, sf):
    return infer.nbest(fx.kw_query(spark, sf), fx.lexicon(spark, sf), 5)


_BY_LANGUAGE = f"""c as (select source, src_lang, tgt_lang, {O.strip('target')} as target, min(cand_rank) as cand_rank
      from (select * from lang_lexicon
            qualify row_number() over (partition by source, src_lang, tgt_lang order by cand_rank, target) <= 5)
      where {O.strip('target')} <> '' group by all)"""


@register("nbest_by_language", O.with_(fx.LANG_SQL, _BY_LANGUAGE) + f"""
select q.source, q.src_lang, q.tgt_lang, q.volume, c.target, c.cand_rank
from lang_query q join c on q.source = c.source and q.src_lang = c.src_lang and q.tgt_lang = c.tgt_lang
where lower(q.source) <> 'source' and {O.strip('q.source')} <> ''""")
def q_nbest_by_language(spark, sf):
    return infer.nbest(fx.lang_query(spark, sf), fx.lang_lexicon(spark, sf), 5)


@register("predict_by_language", O.with_(fx.LANG_SQL) + f"""
, b as (select *, {O.strip('target')} as p from lang_lexicon
      qualify row_number() over (partition by source, src_lang, tgt_lang order by cand_rank, target) = 1)
select q.source, q.tgt_lang, q.volume, coalesce(b.p, q.source) as prediction from lang_query q
left join b on q.source = b.source and q.src_lang = b.src_lang and q.tgt_lang = b.tgt_lang""")
def q_predict_by_language(spark, sf):
    return infer.predict(fx.lang_query(spark, sf), fx.lang_lexicon(spark, sf)).select(
        "source", "tgt_lang", "volume", "prediction")


@register("nbest_dedup", O.with_(O.LEXICON_SQL) + f"""
, c as (select source, target, cand_rank from lexicon
      qualify row_number() over (partition by source order by cand_rank, target) <= 5),
s as (select source, {O.strip('target')} as target, min(cand_rank) as r from c
      where {O.strip('target')} <> '' group by all)
select source, cast(row_number() over (partition by source order by r) - 1 as bigint) as pos, target from s""")
def q_nbest_dedup(spark, sf):
    top = infer.lexicon_topk(fx.lexicon(spark, sf), 5)
    arr = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("cand_rank", "target"))).alias("_l"))
    arr = arr.select("source", clean.nbest_distinct(F.transform("_l", lambda x: x["target"])).alias("nb"))
    return arr.select("source", F.posexplode("nb").alias("pos", "target")) \
              .withColumn("pos", F.col("pos").cast("long"))


@register("lang_pair_groups", O.with_(O.KW_QUERY_SQL)
          + f"select src_lang, tgt_lang, count(*) as n from kw_query where source is not null "
            f"and lower(source) <> 'source' and {O.strip('source')} <> '' "
            "and src_lang is not null and tgt_lang is not null group by all")
def q_lang_pair_groups(spark, sf):
    q = clean.clean_queries(fx.kw_query(spark, sf), "source")
    return q.where(F.col("src_lang").isNotNull() & F.col("tgt_lang").isNotNull()) \
            .groupBy("src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("n"))


@register("batch_predict", O.with_(O.KW_QUERY_SQL, O.LEXICON_SQL) + f"""
, b as (select source as s, {O.strip('target')} as p from lexicon
      qualify row_number() over (partition by source order by cand_rank, target) = 1)
select source, tgt_lang, coalesce(p, source) as prediction from kw_query left join b on kw_query.source = b.s""")
def q_batch_predict(spark, sf):
    return infer.predict(fx.kw_query(spark, sf), fx.lexicon(spark, sf)).select(
        "source", "tgt_lang", "prediction")


_TRIM = f"""n as (select *, {O.norm('target')} as target_norm from kw),
d as (select * from n qualify row_number() over (partition by source, target_norm order by ord) = 1),
t as (select * from d where source is not null
      qualify row_number() over (partition by source order by volume desc nulls last, ord) <= 5)"""


@register("candidate_trim", O.with_(O.KW_SQL, _TRIM)
          + "select source, src_lang, target, tgt_lang, volume from t")
def q_candidate_trim(spark, sf):
    return C.trim_candidates(fx.kw(spark, sf), 5)


@register("global_limit", O.with_(O.KW_SQL, _TRIM)
          + "select source, src_lang, target, tgt_lang, volume from t order by volume desc nulls last, ord limit 100")
def q_global_limit(spark, sf):
    return C.trim_candidates(fx.kw(spark, sf), 5, max_kws=100)


@register("sort_dynamic", O.with_(O.KW_SQL)
          + "select ord, cast(row_number() over (order by volume desc nulls last, ord) - 1 as bigint) as pos from kw")
def q_sort_dynamic(spark, sf):
    return io.positional_id(fx.kw(spark, sf), [F.col("volume").desc_nulls_last(), F.col("ord")], "pos") \
             .select("ord", "pos")


@register("prefix_sample", O.with_(O.MT_SQL)
          + "select id, system from (select *, row_number() over (order by id) - 1 as ord from mt) where ord < 100")
def q_prefix_sample(spark, sf):
    m = io.positional_id(fx.mt(spark, sf), ["id"], "ord")
    return rank.prefix_sample(m, 100, "ord").select("id", "system")


@register("preview", O.with_(O.KW_SQL) + "select ord, source, target from kw order by ord limit 5")
def q_preview(spark, sf):
    return fx.kw(spark, sf).orderBy("ord").limit(5).select("ord", "source", "target")


@register("hash_sample", O.with_(O.KW_SQL)
          + "select ord, source from kw order by md5('42:' || cast(ord as varchar)), ord limit 10")
def q_hash_sample(spark, sf):
    return rank.hash_sample(fx.kw(spark, sf), 10, 42, "ord").select("ord", "source")


# ---- vocabulary and encoding -------------------------------------------------------

_VOCAB = f"""words as (select unnest({O.tokens('source')}) as word from kw
                  union all select unnest({O.tokens('target')}) from kw),
vocab as (select word, count(*) as count,
                 cast(row_number() over (order by count(*) desc, word) - 1 + 3 as integer) as token_id
          from words group by word)"""


@register("vocab_build", O.with_(O.KW_SQL, _VOCAB) + "select word, count, token_id from vocab")
def q_vocab_build(spark, sf):
    kw = fx.kw(spark, sf).select(F.col("source").alias("input"), "target")
    return infer.vocab_build(kw).select("word", "count", "token_id")


def _enc_sql(col: str, n: int, pad: int, name: str) -> str:
    return f"""{name}_t as (
  select ord, list(coalesce(v.token_id, 1) order by pos) as ids from (
     select ord, unnest({O.tokens(col)}) as word, unnest(range(1, len({O.tokens(col)}) + 1)) as pos from kw) x
  left join vocab v using (word) group by ord),
{name} as (
  select kw.ord, list_concat(coalesce(ids, [])[1:{n - 1}], [2]) as body from kw left join {name}_t using (ord))"""


@register("encode_fixed_length", O.with_(O.KW_SQL, _VOCAB, _enc_sql("source", 16, 0, "src"),
                                         _enc_sql("target", 8, 0, "tgt")) + """
select src.ord as id,
  array_to_string(list_concat(src.body, list_transform(range(16 - len(src.body)), lambda x: 0)), ' ') as input_ids,
  array_to_string(list_concat(list_transform(src.body, lambda x: 1), list_transform(range(16 - len(src.body)), lambda x: 0)), ' ') as attention_mask,
  array_to_string(list_concat(tgt.body, list_transform(range(8 - len(tgt.body)), lambda x: 0)), ' ') as labels
from src join tgt using (ord)""")
def q_encode_fixed_length(spark, sf):
    kw = fx.kw(spark, sf).select(F.col("ord").alias("id"), F.col("source").alias("input"), "target")
    vocab = infer.vocab_build(kw)
    e = infer.encode_fixed_length(kw, vocab, "id", 16, 8)
    return e.select("id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"),
                    F.array_join("labels_ids", " ").alias("labels"))


# ---- projections / schema ---------------------------------------------------------

@register("rename_pair", O.with_(O.KW_SQL) + "select source as input, target from kw")
def q_rename_pair(spark, sf):
    return fx.kw(spark, sf).withColumnsRenamed({"source": "input"}).select("input", "target")


@register("required_columns", O.with_(O.KW_SQL) + "select * from kw")
def q_required_columns(spark, sf):
    return clean.require_columns(fx.kw(spark, sf), ["source", "src_lang", "target", "tgt_lang",
                                                    "actual_volume"])


@register("drop_columns", O.with_(O.KW_SQL) + "select ord, source, target, tgt_lang, actual_volume from kw")
def q_drop_columns(spark, sf):
    return fx.kw(spark, sf).drop("volume", "src_lang")


@register("drop_missing_source", O.with_(O.KW_SQL)
          + "select ord, source from kw where actual_volume is not null")
def q_drop_missing_source(spark, sf):
    d = fx.kw(spark, sf).select("ord", F.when(F.col("actual_volume").isNotNull(), F.col("source")).alias("source"))
    return clean.drop_missing(d, ["source"])


@register("drop_header_echo", O.with_(O.KW_SQL)
          + "select ord, s as source from (select ord, case when ord % 7 = 0 then 'Source' else source end as s from kw) "
            "where lower(s) <> 'source'")
def q_drop_header_echo(spark, sf):
    d = fx.kw(spark, sf).select("ord", F.when(F.col("ord") % 7 == 0, F.lit("Source"))
                                .otherwise(F.col("source")).alias("source"))
    return clean.drop_header_echo(d, "source")


@register("drop_blank", O.with_(O.KW_SQL)
          + f"select ord, target from kw where {O.strip('target')} <> '' and ord % 5 <> 0")
def q_drop_blank(spark, sf):
    d = fx.kw(spark, sf).select("ord", F.when(F.col("ord") % 5 == 0, F.lit("   "))
                                .otherwise(F.col("target")).alias("target"))
    return clean.drop_blank(d, "target")


@register("positional_id", O.with_(O.MT_SQL)
          + "select id as key, cast(row_number() over (order by id) - 1 as bigint) as id from mt")
def q_positional_id(spark, sf):
    m = fx.mt(spark, sf).select(F.col("id").alias("key"))
    return io.positional_id(m, ["key"], "id")


def _template_sql(intents: bool = True) -> str:
    parts = ["'Keyword: ' || \"Keyword\"", "'Volume: ' || cast(\"Volume\" as varchar)",
             "'SERP: ' || \"SERP Features\""] + (["'Intents: ' || \"Intents\""] if intents else [])
    return " || ' | ' || ".join(parts)


@register("keyword_template", O.with_(O.KW_EXPORT_SQL)
          + f'select "ID" as id, {_template_sql()} as input from kw_export')
def q_keyword_template(spark, sf):
    from ..operators import bitext
    e = fx.kw_export(spark, sf)
    return e.select(F.col("ID").alias("id"), bitext.keyword_template(e, True).alias("input"))


@register("unquote", O.with_(O.KW_EXPORT_SQL) + f"""
select "ID" as id, case when length(s) >= 2 and starts_with(s, '"') and ends_with(s, '"')
  then substr(s, 2, length(s) - 2) else s end as unquoted
from (select "ID", {O.strip('''case when "ID" % 2 = 0 then ' "' || "Keyword" || '" ' else "Keyword" end''')} as s from kw_export)""")
def q_unquote(spark, sf):
    e = fx.kw_export(spark, sf)
    raw = F.when(F.col("ID") % 2 == 0, F.concat(F.lit(' "'), F.col("Keyword"), F.lit('" '))) \
           .otherwise(F.col("Keyword"))
    return e.select(F.col("ID").alias("id"), T.unquote(raw).alias("unquoted"))


@register("path_parts", O.with_(O.KW_SQL) + """
select ord, regexp_extract(p, '[^/]+$', 0) as file,
       regexp_replace(regexp_extract(p, '[^/]+$', 0), '(\\.[^./]*)$', '_clean\\1') as out_name
from (select ord, '/data/' || tgt_lang || '/' || replace(split_part(source, ' ', 1), ' ', '_') || '_cands.csv' as p from kw)""")
def q_path_parts(spark, sf):
    p = F.concat(F.lit("/data/"), F.col("tgt_lang"), F.lit("/"),
                 F.split(F.col("source"), " ", 2)[0], F.lit("_cands.csv"))
    base, out = io.file_parts(p)
    return fx.kw(spark, sf).select("ord", base.alias("file"), out.alias("out_name"))


@register("volume_enrich", O.with_(O.KW_SQL) + f""", kv as (select lower(p_brand) as target_norm,
              case p_partkey % 3 when 0 then 'de_DE' when 1 then 'nl_XX' else 'fr_XX' end as tgt_lang,
              max(cast(p_size * 10 as bigint)) as actual_volume from part group by all)
select k.ord, k.target_norm, k.tgt_lang, kv.actual_volume
from (select ord, {O.norm('target')} as target_norm, tgt_lang from kw) k
left join kv using (target_norm, tgt_lang)""")
def q_volume_enrich(spark, sf):
    cands = fx.kw(spark, sf).select("ord", T.normalize_text("target").alias("target_norm"), "tgt_lang")
    p = fx.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    m3 = F.col("p_partkey") % 3
    kws = p.select(F.lower("p_brand").alias("term"),
                   F.when(m3 == 0, "de_DE").when(m3 == 1, "nl_XX").otherwise("fr_XX").alias("lang"),
                   (F.col("p_size") * 10).cast("long").alias("volume"))
    return ledger.volume_enrich(cands, kws)


_ZIP = O.with_(O.KW_EXPORT_SQL) + f""", s as (select "ID" as i, {_template_sql()} as input from kw_export),
t as (select "ID" as i, upper("Intents") as target from kw_export)
select input, target from s join t using (i)"""


def _two_exports(spark, sf):
    """A source export and a target export of the same rows in the same order, in files of their own, with positions."""
    e, frames = fx.kw_export(spark, sf), []
    for name, keyword, files in (("src", F.col("Keyword"), 3), ("tgt", F.upper("Intents"), 5)):
        path = scratch_path(spark, f"export-{name}")
        rows = e.withColumn("Keyword", keyword).repartitionByRange(files, "ID").sortWithinPartitions("ID")
        io.write_table(rows.toDF("\ufeff\"#\"", *e.columns[1:]), path, fmt="csv", sep="\t", encoding="UTF-16LE")
        frames.append(io.read_keyword_export(spark, path, with_ord=True))
    return frames


@register("positional_zip", _ZIP)
def q_positional_zip(spark, sf):
    """Paired by the rows' places in files that are cut differently."""
    return bitext.build_parallel(*_two_exports(spark, sf))


@register("keyed_zip", _ZIP)
def q_keyed_zip(spark, sf):
    """Paired by the ID that both exports carry; the target side is in another order."""
    src, tgt = _two_exports(spark, sf)
    return bitext.build_parallel(src, tgt.orderBy(F.hash("ID")), by="ID")
