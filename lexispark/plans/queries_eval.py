"""L3 queries: metrics for all systems in one job, over the ``mt`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import text as T
from ..operators import metrics as M
from ..sources import fixtures as fx
from .catalog import register

_NGRAM_CTES = f"""tk as (
  select system, id, {O.tok13a('prediction')} as h, {O.tok13a('target')} as r from mt),
ns as (select unnest([1, 2, 3, 4]) as n),
hp as (select system, id, n, unnest(range(1, len(h) - n + 2)) as i, h from tk, ns),
rp as (select system, id, n, unnest(range(1, len(r) - n + 2)) as i, r from tk, ns),
hc as (select system, id, n, array_to_string(h[i:i + n - 1], ' ') as g, count(*) as c
       from hp group by all),
rc as (select system, id, n, array_to_string(r[i:i + n - 1], ' ') as g, count(*) as c
       from rp group by all),
cnt as (
  select s.system, s.n,
         cast(coalesce(sum(least(hc.c, coalesce(rc.c, 0))), 0) as bigint) as correct,
         cast(coalesce((select sum(c) from hc h2 where h2.system = s.system and h2.n = s.n), 0) as bigint) as total
  from (select distinct system, n from tk, ns) s
  left join hc on hc.system = s.system and hc.n = s.n
  left join rc on rc.system = hc.system and rc.id = hc.id and rc.n = hc.n and rc.g = hc.g
  group by s.system, s.n),
lens as (select system, cast(sum(len(h)) as bigint) as sys_len, cast(sum(len(r)) as bigint) as ref_len
         from tk group by system)"""


def _bleu_sql() -> str:
    piv = ",\n".join(
        f"max(case when n = {n} then correct end) as c{n}, max(case when n = {n} then total end) as t{n}"
        for n in range(1, 5))
    k = lambda n: " + ".join(f"(case when c{m} = 0 then 1 else 0 end)" for m in range(1, n + 1))
    logs = " + ".join(
        f"ln(case when c{n} = 0 then 100.0 / (pow(2.0, {k(n)}) * t{n}) else 100.0 * c{n} / t{n} end)"
        for n in range(1, 5))
    return O.with_(O.MT_SQL, _NGRAM_CTES, f"""w as (
  select c.system, l.sys_len, l.ref_len, {piv}
  from cnt c join lens l using (system) group by c.system, l.sys_len, l.ref_len)""") + f"""
select system, sys_len, ref_len, c1, c2, c3, c4, t1, t2, t3, t4,
  case when (c1 = 0 and c2 = 0 and c3 = 0 and c4 = 0) or t1 = 0 or t2 = 0 or t3 = 0 or t4 = 0 then 0.0
  else (case when sys_len < ref_len then (case when sys_len > 0 then exp(1 - ref_len / sys_len) else 0.0 end)
        else 1.0 end) * exp(({logs}) / 4) end as bleu,
  '{M.BLEU_SIGNATURE}' as signature
from w"""


@register("bleu_ngram_counts", O.with_(O.MT_SQL, _NGRAM_CTES) + "select system, cast(n as bigint) as n, correct, total from cnt")
def q_bleu_ngram_counts(spark, sf):
    return M.bleu_ngram_counts(fx.mt(spark, sf), ["system"])


@register("corpus_bleu", _bleu_sql())
def q_corpus_bleu(spark, sf):
    return M.corpus_bleu(fx.mt(spark, sf), ["system"])


@register("bleu_signature", O.with_(O.MT_SQL)
          + f"select distinct system, '{M.BLEU_SIGNATURE}' as signature from mt")
def q_bleu_signature(spark, sf):
    return M.corpus_bleu(fx.mt(spark, sf), ["system"]).select("system", "signature")


@register("corpus_ter")
def q_corpus_ter(spark, sf):
    return M.corpus_ter(fx.mt(spark, sf), ["system"])


_TER_TOKENS = f"""tk as (select id, system, {O.tokens("lower(coalesce(prediction, ''))")} as h,
  {O.tokens("lower(coalesce(target, ''))")} as r from mt)"""
# One row of the distance table per step; a running minimum stands for the insertions.
_TER_TABLE = """dp as (select id, system, h, r, 0 as i, range(len(r) + 1) as d from tk
  union all
  select id, system, h, r, i + 1, list_transform(range(len(r) + 1), lambda j: j + list_min(list_transform(range(j + 1),
    lambda k: case when k = 0 then d[1] + 1 else least(d[k + 1] + 1, d[k] + (h[i + 1] <> r[k])::int) - k end)))
  from dp where i < len(h))"""


@register("ter_edit_distance", O.with_(O.MT_SQL, _TER_TOKENS, _TER_TABLE).replace("with ", "with recursive ", 1)
          + "select id, system, cast(d[len(r) + 1] as bigint) as edit_distance from dp where i = len(h)")
def q_ter_edit_distance(spark, sf):
    return M.edit_distances(fx.mt(spark, sf)).select("id", "system", "edit_distance")


@register("ter_substitutions", O.with_(O.MT_SQL, _TER_TOKENS) + """
select system, cast(sum((len(r) + 2) // 3) as bigint) as edits, cast(sum(len(r)) as bigint) as ref_words,
  100 * (cast(sum((len(r) + 2) // 3) as double) / cast(sum(len(r)) as double)) as ter from tk group by system""")
def q_ter_substitutions(spark, sf):
    """TER where no shift can help: each third word of the reference is replaced by one that it does not have."""
    words = F.transform(T.tokenize_ter("target"), lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("\u241e"), w)).otherwise(w))
    made = fx.mt(spark, sf).withColumn("prediction", F.array_join(words, " "))
    return M.corpus_ter(made, ["system"]).select("system", "edits", "ref_words", "ter")


# The exact stage pairs the k-th last occurrence of a word with the k-th last in the reference.
_METEOR_EXACT = """hw as (select id, system, unnest(range(len(h))) as p, unnest(h) as w from tk),
rw as (select id, system, unnest(range(len(r))) as p, unnest(r) as w from tk),
hk as (select *, row_number() over (partition by id, system, w order by p desc) as k from hw),
rk as (select *, row_number() over (partition by id, system, w order by p desc) as k from rw),
al as (select hk.id, hk.system, hk.p as hp, rk.p as rp from hk join rk using (id, system, w, k)),
st as (select *, lag(hp) over w as hp0, lag(rp) over w as rp0 from al window w as (partition by id, system order by hp)),
ct as (select id, system, count(*) as m, sum(case when hp0 + 1 = hp and rp0 + 1 = rp then 0 else 1 end) as c from st group by all)"""


@register("meteor_exact", O.with_(O.MT_SQL, _TER_TOKENS, _METEOR_EXACT)
          + "select id, system, cast(coalesce(m, 0) as bigint) as matches, cast(len(h) as bigint) as hyp_words, "
            "cast(len(r) as bigint) as ref_words, cast(coalesce(c, 0) as bigint) as chunks from tk left join ct using (id, system)")
def q_meteor_exact(spark, sf):
    return M.meteor_segments(fx.mt(spark, sf), stages="exact").select("id", "system", "matches", "hyp_words", "ref_words", "chunks")


@register("mean_meteor")
def q_mean_meteor(spark, sf):
    return M.mean_meteor(fx.mt(spark, sf), ["system"])


@register("comet_rollup", O.with_(O.MT_SQL)
          + "select system, avg(comet_score_segment) as comet_score_system, count(*) as segments "
            "from mt group by system")
def q_comet_rollup(spark, sf):
    return fx.mt(spark, sf).groupBy("system").agg(
        F.avg("comet_score_segment").alias("comet_score_system"),
        F.count(F.lit(1)).alias("segments"))


@register("system_score_column", O.with_(O.MT_SQL)
          + "select id, system, comet_score_segment, "
            "avg(comet_score_segment) over (partition by system) as comet_score_system from mt")
def q_system_score_column(spark, sf):
    return M.comet_rollup(fx.mt(spark, sf)).select(
        "id", "system", "comet_score_segment", "comet_score_system")


@register("comet_triples", O.with_(O.MT_SQL)
          + "select id, source as src, prediction as mt, target as ref from mt")
def q_comet_triples(spark, sf):
    return M.comet_triples(fx.mt(spark, sf)).select("id", "triple.*")


@register("align_hyp_ref", O.with_(O.MT_SQL)
          + "select id, system, prediction, target from mt")
def q_align_hyp_ref(spark, sf):
    m = fx.mt(spark, sf)
    return M.align_hyp_ref(m.select("id", "system", "prediction"), m.select("id", "target"), ["id"])


@register("ws_tokens", O.with_(O.MT_SQL)
          + f"select id, cast(len({O.tokens('prediction')}) as bigint) as n_tokens, "
            f"array_to_string({O.tokens('prediction')}, ' ') as joined from mt")
def q_ws_tokens(spark, sf):
    t = T.ws_tokens("prediction")
    return fx.mt(spark, sf).select("id", F.size(t).cast("long").alias("n_tokens"),
                                   F.array_join(t, " ").alias("joined"))


@register("keyword_preservation", O.with_(O.MT_SQL)
          + f"select system, avg(case when {O.norm('prediction')} = {O.norm('target')} then 1.0 else 0.0 end) as match_rate, "
            f"avg(case when {O.norm('prediction')} = {O.norm('source')} then 1.0 else 0.0 end) as copy_rate, "
            "count(*) as n from mt group by system")
def q_keyword_preservation(spark, sf):
    from ..operators import ledger
    return ledger.keyword_preservation(fx.mt(spark, sf), ["system"])
