"""DuckDB oracle SQL for every registered query (the correctness gate).

Only the pre-registered driver tables may be used, so fixture views are
inlined as CTEs. Regex-bearing expressions are generated here once; DuckDB
string literals keep backslashes as written (RE2 syntax).
"""

from __future__ import annotations

from .sources.fixtures import KW_EXPORT_SQL, KW_QUERY_SQL, KW_SQL, LEXICON_SQL, MT_SQL

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '[.,;!?]+$', '')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def tok13a(x: str) -> str:
    s = rstrip(x)
    s = f"replace({s}, '<skipped>', '')"
    s = f"replace({s}, '-' || chr(10), '')"
    s = f"replace({s}, chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    s = rf"regexp_replace({s}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g')"
    s = rf"regexp_replace({s}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
    s = rf"regexp_replace({s}, '([\.,])([^0-9])', ' \1 \2', 'g')"
    s = rf"regexp_replace({s}, '([0-9])(-)', '\1 \2 ', 'g')"
    return tokens(s)


def valid(x: str) -> str:
    s = strip(x)
    return (f"coalesce(length({s}) >= 2 and {s} not in ('news news','webs','nltv') "
            f"and not contains({s}, '  '), false)")


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# L1 building blocks over the kw fixture -----------------------------------

def l1_filtered(min_sv: float = 1, lo: int = 2, hi: int = 60) -> str:
    return f"""l1_filtered as (
  select ord, {strip('source')} as source, src_lang, {strip('target')} as target, tgt_lang,
         volume, actual_volume, {norm('target')} as target_norm
  from kw
  where coalesce(cast(actual_volume as double), 0) >= {float(min_sv)}
    and coalesce(length({strip('source')}) between {lo} and {hi}
             and length({strip('target')}) between {lo} and {hi}, false)
    and {valid(norm('target'))})"""


L1_DEDUP = """l1_dedup as (
  select * from l1_filtered
  qualify row_number() over (partition by source, target_norm order by ord) = 1)"""


def l1_topk(k: int = 1) -> str:
    return f"""l1_full as (
  select * from l1_dedup
  qualify row_number() over (partition by source order by actual_volume desc nulls last, ord) <= {k})"""


def l1(k: int = 1) -> str:
    return with_(KW_SQL, l1_filtered(), L1_DEDUP, l1_topk(k))


def group_split_cte(src: str, key: str, frac: float, seed: int, name: str) -> str:
    return f"""{name}_keys as (
  select {key} as k, row_number() over (order by md5('{seed}:' || cast({key} as varchar)), {key}) as pos,
         count(*) over () as n
  from (select distinct {key} from {src} where {key} is not null)),
{name} as (
  select s.*, case when g.pos <= floor(g.n * cast({frac} as double)) then 'train' else 'eval' end as split
  from {src} s left join {name}_keys g on s.{key} = g.k)"""


__all__ = ["KW_SQL", "KW_EXPORT_SQL", "KW_QUERY_SQL", "LEXICON_SQL", "MT_SQL"]
