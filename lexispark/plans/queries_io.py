"""Source / sink queries: each writes fixture data to the shared checkpoint
folder with one distributed write, then returns the lazy read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import oracle as O
from ..functions import text as T
from ..operators import ledger, rank, split, stats
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io
from . import candidates as C
from . import prepare as P
from .catalog import register

KW_SCHEMA = T_.StructType([
    T_.StructField("ord", T_.LongType()), T_.StructField("source", T_.StringType()),
    T_.StructField("src_lang", T_.StringType()), T_.StructField("target", T_.StringType()),
    T_.StructField("tgt_lang", T_.StringType()), T_.StructField("volume", T_.LongType()),
    T_.StructField("actual_volume", T_.LongType())])
MT_SCHEMA = "id long, source string, target string, prediction string, system string, " \
            "comet_score_segment double"


def _kw_csv(spark, sf) -> str:
    path = scratch_path(spark, "kw-csv")
    io.write_table(fx.kw(spark, sf), path, fmt="csv")
    return path


@register("csv_scan", O.with_(O.KW_SQL) + "select * from kw")
def q_csv_scan(spark, sf):
    return io.read_csv(spark, _kw_csv(spark, sf), KW_SCHEMA, with_ord=False)


@register("csv_sink_roundtrip", O.with_(O.MT_SQL) + "select * from mt")
def q_csv_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "mt-csv")
    io.write_table(fx.mt(spark, sf), path, fmt="csv")
    return io.read_csv(spark, path, MT_SCHEMA, multiline=True, with_ord=False)


def _export_files(spark, sf, extra: bool = True) -> str:
    """The keyword export as UTF-16-LE TSV: BOM + quoted '#' header, one file per task."""
    e = fx.kw_export(spark, sf)
    if extra:
        e = e.withColumn("Parent Topic", F.lower("Keyword"))
    e = e.toDF("﻿\"#\"", *e.columns[1:])
    path = scratch_path(spark, "export-tsv")
    io.write_table(e, path, fmt="csv", sep="\t", encoding="UTF-16LE", quoteAll=False)
    return path


@register("utf16_export_scan", O.with_(O.KW_EXPORT_SQL) + "select * from kw_export")
def q_utf16_export_scan(spark, sf):
    return io.read_keyword_export(spark, _export_files(spark, sf), include_intents=True)


@register("header_normalise", O.with_(O.KW_EXPORT_SQL)
          + 'select "ID", "Keyword", "Volume", "SERP Features", "Intents", lower("Keyword") as "Parent Topic" from kw_export')
def q_header_normalise(spark, sf):
    path = _export_files(spark, sf)
    df = (spark.read.option("header", True).option("sep", "\t").option("encoding", "UTF-16LE")
          .option("lineSep", "\n").option("quote", '"').option("escape", '"').csv(path))
    out = io.clean_header(df)
    return out.withColumn("ID", F.col("ID").cast("long")).withColumn("Volume", F.col("Volume").cast("long"))


@register("prune_columns", O.with_(O.KW_EXPORT_SQL)
          + 'select "ID", "Keyword", "Volume", "SERP Features" from kw_export')
def q_prune_columns(spark, sf):
    return io.read_keyword_export(spark, _export_files(spark, sf), include_intents=False)


@register("bitext_scan", O.with_(O.MT_SQL) + "select id, source, target from mt")
def q_bitext_scan(spark, sf):
    path = scratch_path(spark, "bitext")
    m = fx.mt(spark, sf).select("id", F.struct(F.col("source").alias("de"),
                                               F.col("target").alias("en")).alias("translation"))
    io.write_table(m, path)
    return io.flatten_bitext(spark.read.parquet(path), "de", "en")


@register("bitext_flatten", O.with_(O.MT_SQL)
          + "select id, source, case when id % 4 = 0 then '' else target end as target from mt")
def q_bitext_flatten(spark, sf):
    path = scratch_path(spark, "bitext-map")
    m = fx.mt(spark, sf)
    mp = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("de"), F.col("source"))) \
          .otherwise(F.create_map(F.lit("de"), F.col("source"), F.lit("en"), F.col("target")))
    io.write_table(m.select("id", mp.alias("translation")), path)
    return io.flatten_bitext(spark.read.parquet(path), "de", "en")


_DICT_TXT = """case when ord % 10 = 0 then '{''de'': ''' || source
  when ord % 10 = 1 then '{''de'': ''' || source || '''}'
  else '{''de'': ''' || source || ''', ''en'': ''' || target || '''}' end"""


@register("dict_literal_parse", O.with_(O.KW_SQL) + """
select ord, case when ord % 10 = 0 then null else source end as source,
  case when ord % 10 in (0, 3) then null when ord % 10 = 1 then '' when ord % 10 = 2 then target || chr(160) || 'None' else target end as target
from kw""")
def q_dict_literal_parse(spark, sf):
    kw = fx.kw(spark, sf)
    k = F.col("ord") % 10
    txt = (F.when(k == 0, F.concat(F.lit("{'de': '"), "source"))
           .when(k == 1, F.concat(F.lit("{'de': '"), "source", F.lit("'}")))
           .when(k == 2, F.concat(F.lit("{'de': '"), "source", F.lit("', 'en': '"), "target", F.lit("\\xa0None'}")))
           .when(k == 3, F.concat(F.lit("{'en': None, 'de': '"), "source", F.lit("'}")))
           .otherwise(F.concat(F.lit("{'de': '"), "source", F.lit("', 'en': '"), "target", F.lit("'}"))))
    m = io.parse_dict_literal(txt)
    get = lambda key: F.when(m.isNull(), F.lit(None)).otherwise(
        F.when(F.map_contains_key(m, key), F.try_element_at(m, F.lit(key))).otherwise(""))
    return kw.select("ord", get("de").alias("source"), get("en").alias("target"))


def _cand_files(spark, sf) -> str:
    path = scratch_path(spark, "cands")
    kw = fx.kw(spark, sf).withColumn("file", F.concat("tgt_lang", F.lit("_cands.csv")))
    io.write_table(kw, path, fmt="csv", partition_by=["file"])
    return path


def _read_cands(spark, path, glob="*_cands.csv") -> DataFrame:
    return io.read_csv(spark, f"{path}/file={glob}", KW_SCHEMA, with_ord=False, basePath=path)


_FILE_TRIM = f"""n as (select *, tgt_lang || '_cands.csv' as file, {O.norm('target')} as target_norm from kw),
d as (select * from n qualify row_number() over (partition by file, source, target_norm order by ord) = 1),
t as (select * from d where source is not null
      qualify row_number() over (partition by file, source order by volume desc nulls last, ord) <= 5)"""


@register("glob_per_file_topk", O.with_(O.KW_SQL, _FILE_TRIM)
          + "select file, source, src_lang, target, tgt_lang, volume from t")
def q_glob_per_file_topk(spark, sf):
    return C.trim_candidates(_read_cands(spark, _cand_files(spark, sf)), 5, group_cols=["file"])


@register("file_provenance", O.with_(O.KW_SQL)
          + "select ord, tgt_lang || '_cands.csv' as file from kw")
def q_file_provenance(spark, sf):
    d = io.read_csv(spark, f"{_cand_files(spark, sf)}/file=*_cands.csv", KW_SCHEMA, with_ord=False, with_file=True)
    return d.select("ord", F.regexp_extract("file_path", "/file=([^/]+)/[^/]+$", 1).alias("file"))


@register("csv_input_order", O.with_(O.KW_SQL)
          + """select ord, row_number() over (order by case when ord % 10 = 0 then 0 else 1 end, ord) - 1 as position from kw""")
def q_csv_input_order(spark, sf):
    """A short file, then one nine times as long, each sorted: positions follow the paths and the rows in them."""
    kw, path = fx.kw(spark, sf), scratch_path(spark, "ordered")
    for name, rows in (("a", F.col("ord") % 10 == 0), ("b", F.col("ord") % 10 != 0)):
        io.write_table(kw.where(rows).orderBy("ord"), f"{path}/{name}.csv", fmt="csv")
    schema = T_.StructType([T_.StructField("n", T_.LongType()), *KW_SCHEMA.fields[1:]])
    d = io.read_csv(spark, f"{path}/*.csv", schema)
    return d.select(F.col("n").alias("ord"), F.col("ord").alias("position"))


_CSV_POSITIONS = O.with_(O.KW_SQL) + """, placed as (select *, row_number() over (order by case when ord % 10 = 0 then 0 else 1 end, ord) - 1 as place
  from kw)"""


def _placed_csv(spark, sf):
    """kw in a short file and one nine times as long, read back with positions."""
    kw, path = fx.kw(spark, sf), scratch_path(spark, "placed")
    for name, rows in (("a", F.col("ord") % 10 == 0), ("b", F.col("ord") % 10 != 0)):
        io.write_table(kw.where(rows).orderBy("ord"), f"{path}/{name}.csv", fmt="csv")
    schema = T_.StructType([T_.StructField("n", T_.LongType()), *KW_SCHEMA.fields[1:]])
    return io.read_csv(spark, f"{path}/*.csv", schema)


@register("csv_row_split", _CSV_POSITIONS + """,
ranked as (select ord, row_number() over (order by md5('42:' || cast(place as varchar)), place) as pos, count(*) over () as n from placed),
cuts as (select *, ceil(n * cast(0.1 as double)) as c1,
                ceil(n * cast(0.1 as double)) + ceil((n - ceil(n * cast(0.1 as double))) * cast(0.1111 as double)) as c2 from ranked)
select ord, case when pos <= c1 then 'test' when pos <= c2 then 'dev' else 'train' end as split from cuts""")
def q_csv_row_split(spark, sf):
    """X2 on rows of files: the split follows the rows' places, not the way the scan is cut."""
    return split.three_way_split(_placed_csv(spark, sf), "ord").select(F.col("n").alias("ord"), "split")


@register("csv_hash_sample", _CSV_POSITIONS + """
select ord, source from placed order by md5('42:' || cast(place as varchar)), place limit 10""")
def q_csv_hash_sample(spark, sf):
    return rank.hash_sample(_placed_csv(spark, sf), 10, 42, "ord").select(F.col("n").alias("ord"), "source")


@register("csv_positional_id", _CSV_POSITIONS + "select ord as n, place as id from placed")
def q_csv_positional_id(spark, sf):
    """P8 on a file scan: no sort, no check-point."""
    kw, path = fx.kw(spark, sf), scratch_path(spark, "numbered")
    for name, rows in (("a", F.col("ord") % 10 == 0), ("b", F.col("ord") % 10 != 0)):
        io.write_table(kw.where(rows).orderBy("ord").select(F.col("ord").alias("n"), "source"), f"{path}/{name}.csv", fmt="csv")
    return io.add_id_if_absent(io.read_csv(spark, f"{path}/*.csv", "n long, source string", with_ord=False)).select("n", "id")


@register("csv_to_csv_l1", O.l1(2) + """
select cast(row_number() over (order by source, actual_volume desc nulls last, ord) - 1 as bigint) as place, source, src_lang, target, tgt_lang,
  volume, actual_volume, target_norm from l1_full""")
def q_csv_to_csv_l1(spark, sf):
    """L1 from a CSV file to CSV files: the input's columns and target_norm, in O1's order."""
    kw, path = fx.kw(spark, sf), scratch_path(spark, "l1")
    io.write_table(kw.orderBy("ord").drop("ord"), f"{path}/in", fmt="csv")
    cols = T_.StructType(KW_SCHEMA.fields[1:])
    P.write_outputs(io.read_csv(spark, f"{path}/in", cols), f"{path}/out", P.PrepConfig(topk_per_source=2), fmt="csv")
    back = io.read_csv(spark, f"{path}/out/clean_full", T_.StructType([*cols.fields, T_.StructField("target_norm", T_.StringType())]))
    return back.withColumnRenamed("ord", "place")


@register("empty_glob_union", O.with_(O.KW_SQL) + "select * from kw")
def q_empty_glob_union(spark, sf):
    path = _cand_files(spark, sf)
    found = io.read_csv(spark, f"{path}/file=*_cands.csv", KW_SCHEMA, with_ord=False)
    return found.unionByName(io.read_csv(spark, f"{path}/file=*_none.csv", KW_SCHEMA, with_ord=False))


@register("derived_output_name", O.with_(O.KW_SQL, _FILE_TRIM)
          + "select regexp_replace(file, '(\\.[^./]*)$', '_clean\\1') as out_file, count(*) as n from t group by all")
def q_derived_output_name(spark, sf):
    t = C.trim_candidates(_read_cands(spark, _cand_files(spark, sf)), 5, group_cols=["file"])
    t = t.withColumn("out_file", T.clean_suffix_name("file")).drop("file")
    out = scratch_path(spark, "trimmed")
    io.write_table(t, out, fmt="csv", partition_by=["out_file"])
    back = spark.read.option("header", True).csv(out)
    return back.groupBy("out_file").agg(F.count(F.lit(1)).alias("n"))


@register("union_files", O.with_(O.KW_SQL)
          + "select ord, source, tgt_lang, case when tgt_lang = 'de_DE' then null else actual_volume end "
            "as actual_volume from kw")
def q_union_files(spark, sf):
    path = _cand_files(spark, sf)
    a = _read_cands(spark, path, "de_DE_cands.csv").select("ord", "source", "tgt_lang")
    b = _read_cands(spark, path, "[!d]*_cands.csv").select("ord", "source", "tgt_lang", "actual_volume")
    return stats.union_files([a, b])


def _three_way_sql() -> str:
    return """ranked as (select ord, row_number() over (order by md5('42:' || cast(ord as varchar)), ord) as pos,
                  count(*) over () as n from kw),
cuts as (select *, ceil(n * cast(0.1 as double)) as c1,
                ceil(n * cast(0.1 as double)) + ceil((n - ceil(n * cast(0.1 as double))) * cast(0.1111 as double)) as c2
         from ranked),
lab as (select ord, case when pos <= c1 then 'test' when pos <= c2 then 'dev' else 'train' end as split from cuts)"""


@register("three_way_split", O.with_(O.KW_SQL, _three_way_sql()) + "select ord, split from lab")
def q_three_way_split(spark, sf):
    return split.three_way_split(fx.kw(spark, sf), "ord", 0.10, 0.1111, 42).select("ord", "split")


@register("split_sink", O.with_(O.KW_SQL, _three_way_sql())
          + "select split, count(*) as n from lab group by split")
def q_split_sink(spark, sf):
    lab = split.three_way_split(fx.kw(spark, sf), "ord", 0.10, 0.1111, 42)
    path = scratch_path(spark, "splits")
    io.write_table(lab.select("ord", "source", "target", "split"), path, fmt="csv", partition_by=["split"])
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("aligned_bitext_scan", O.with_(O.MT_SQL)
          + "select id as ord, source, target from mt where id % 2 = 1")
def q_aligned_bitext_scan(spark, sf):
    from ..functions.lang import FLORES_CODE
    path = scratch_path(spark, "benchmark")
    m = fx.mt(spark, sf).select(
        F.col("id").alias("ord"), F.col("source").alias("sentence_deu_Latn"),
        F.col("target").alias("sentence_eng_Latn"), F.col("prediction").alias("sentence_nld_Latn"),
        F.when(F.col("id") % 2 == 0, "dev").otherwise("devtest").alias("split"))
    io.write_table(m, path, partition_by=["split"])
    return io.read_aligned_benchmark(spark, path, FLORES_CODE["de"], FLORES_CODE["en"], "devtest")


@register("pair_csv_load", O.with_(O.KW_SQL) + "select source, target from kw")
def q_pair_csv_load(spark, sf):
    path = scratch_path(spark, "pairs")
    io.write_table(fx.kw(spark, sf).select(F.col("source").alias("input"), "target"), path, fmt="csv")
    return io.read_pair_csv(spark, path, schema="input string, target string",
                            with_ord=False).select("source", "target")


@register("schema_alternatives", O.with_(O.KW_SQL)
          + "select ord, source, target from kw")
def q_schema_alternatives(spark, sf):
    kw = fx.kw(spark, sf)
    p1, p2 = scratch_path(spark, "alt-src"), scratch_path(spark, "alt-input")
    io.write_table(kw.where(F.col("ord") % 2 == 0).select("ord", "source", "target"), p1, fmt="csv")
    io.write_table(kw.where(F.col("ord") % 2 == 1).select("ord", F.col("source").alias("input"), "target"),
                   p2, fmt="csv")
    a = io.read_pair_csv(spark, p1, schema="ord long, source string, target string", with_ord=False)
    b = io.read_pair_csv(spark, p2, schema="ord long, input string, target string", with_ord=False)
    return stats.union_files([a, b]).select("ord", "source", "target")


# ---- result ledger (E2) and run-set audit (E4) -----------------------------------

# The four result layouts seen in the shipped result files.
LAYOUTS = [
    ["source", "target", "id", "prediction"],
    ["source", "target", "id", "comet_score_system", "prediction"],
    ["source", "target", "prediction", "comet_score_system"],
    ["input", "target", "prediction"],
]
FAMILY = {"sysA": ("mBART-50", "mbart50"), "sysB": ("M2M100", "m2m100")}
PAIRS = ["de_en", "de_nl", "en_nl"]


def _result_files() -> list[tuple[str, str, int, list[str], str, str, str, str]]:
    """One result file per (system, pair) in its layout, a misfiled copy, one whose
    name has two-part variant and whose input is another pair's, and one without
    pair folder and variant: (path, system, remainder, columns, family, pair, folder pair, variant)."""
    out = []
    for fi, (sysname, (fam, prefix)) in enumerate(sorted(FAMILY.items())):
        for pi, pair in enumerate(PAIRS):
            cols = LAYOUTS[(fi * 3 + pi) % 4]
            out.append((f"{fam}/{pair}/{prefix}_{pair}_baseline_eval.csv", sysname, pi, cols, fam, pair, pair, "baseline"))
            if sysname == "sysB" and pair == "en_nl":
                out.append((f"{fam}/de_nl/{prefix}_en_nl_pre_eval.csv", sysname, pi, cols, fam, pair, "de_nl", "pre"))
    out.append(("mBART-50/de_nl/mbart50_de_nl_sv_up_eval.csv", "sysB", 0, LAYOUTS[0], "mBART-50", "de_nl", "de_nl", "sv_up"))
    out.append(("Flat_7b/flat_7b_de_nl_eval.csv", "sysA", 1, LAYOUTS[3], "Flat_7b", "de_nl", "", ""))
    return out


def _write_results(spark, sf) -> list[str]:
    m = fx.mt(spark, sf).withColumn("comet_score_system", F.col("comet_score_segment")) \
                        .withColumn("input", F.col("source"))
    root = scratch_path(spark, "results")
    for path, system, rest, cols, *_ in _result_files():
        io.write_table(m.where((F.col("system") == system) & (F.col("id") % 3 == rest)).select(*cols), f"{root}/{path}", fmt="csv")
    return [f"{root}/{f[0]}" for f in _result_files()]


def _ledger_sql() -> str:
    rows = []
    for _, system, rest, cols, family, pair, folder, variant in _result_files():
        id_c = "id" if "id" in cols else "cast(null as bigint)"
        cs = "comet_score_segment" if "comet_score_system" in cols else "cast(null as double)"
        rows.append(f"select '{family}' as family, '{pair}' as pair, '{folder}' as folder_pair, '{variant}' as variant, {id_c} as id, "
                    f"source, target, prediction, {cs} as comet_score_system from mt where system = '{system}' and id % 3 = {rest}")
    return "ledger as (" + "\nunion all\n".join(rows) + ")"


@register("result_ledger", O.with_(O.MT_SQL, _ledger_sql())
          + "select family, pair, folder_pair, variant, id, source, target, prediction, comet_score_system from ledger")
def q_result_ledger(spark, sf):
    led = ledger.read_result_files(spark, _write_results(spark, sf))
    return led.select("family", "pair", "folder_pair", "variant", "id", "source", "target", "prediction", "comet_score_system")


def _fp(x: str) -> str:
    return f"cast('0x' || substr(md5(coalesce('=' || {x}, 'null')), 1, 15) as bigint)"


@register("run_set_audit", O.with_(O.MT_SQL, _ledger_sql()) + f""",
per as (select family || '/' || pair || '/' || variant as run, min(pair) as pair, count(*) as n_rows,
               cast(sum({_fp('prediction')}) as varchar) as pred_fp, cast(sum({_fp('source')}) as varchar) as src_fp,
               cast(sum(case when prediction is null or {O.strip('prediction')} = '' then 1 else 0 end) as bigint) as n_missing
        from ledger group by all)
select a.run, a.n_rows, a.pred_fp, a.src_fp, a.n_missing,
  (select min(b.run) from per b where b.pred_fp = a.pred_fp and b.n_rows = a.n_rows and b.run <> a.run) as duplicate_of,
  exists (select 1 from per b where b.src_fp = a.src_fp and b.n_rows = a.n_rows and b.pair <> a.pair) as wrong_pair
from per a""")
def q_run_set_audit(spark, sf):
    led = ledger.read_result_files(spark, _write_results(spark, sf))
    led = led.withColumn("run", F.concat_ws("/", "family", "pair", "variant"))
    return ledger.run_set_audit(led, "run", "pair")
