"""Sources and sinks (S1-S7, K1-K3), schema work (P1-P5, P7) and row order.

DataFrames are unordered, so the reference's semantic row order becomes an
explicit ``ord`` column made at the scan: the row's position 0..n-1 in its
files (``positions.py``). ``positional_id`` turns any other total order into
dense positions without a single-task window.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from .positions import with_positions

# The keyword export's kept columns.
EXPORT_KEEP = ["ID", "Keyword", "Volume", "SERP Features"]
EXPORT_INTENTS = "Intents"
# Header names that are spelled otherwise in the kept columns.
HEADER_NAMES = {"#": "ID"}


# ---- CSV (S1, K1) ---------------------------------------------------------

def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T_.StructType | str | None = None,
             missing: str = "null", multiline: bool = False, with_file: bool = False,
             with_ord: bool = True, **options) -> DataFrame:
    """Comma CSV with header; ``"`` doubled inside quotes is decoded.

    ``missing='pandas'`` turns pandas' NA words into null in string columns.
    An explicit schema is the default at scale (no inference pass). A pattern
    that matches no file gives an empty frame then; without a schema, and for a
    plain path that does not exist, Spark's error stays. ``ord`` is the row's
    position in file path and file order, the same at any number of cores and
    size of splits; its counts cost a second pass over the files, so leave it
    out where nothing reads it.
    """
    r = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
         .option("multiLine", multiline).option("mode", "FAILFAST"))
    for k, v in options.items():
        r = r.option(k, v)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    listed = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = r.csv(listed)
    except AnalysisException as e:
        pattern = all(re.search(r"[*?\[{]", p) for p in listed)
        if e.getCondition() != "PATH_NOT_FOUND" or schema is None or not pattern:
            raise
        return _no_rows(spark, schema, with_file, with_ord)
    cols = df.columns
    if with_file:
        df = df.withColumn("file_path", F.col("_metadata.file_path")) \
               .withColumn("file", F.col("_metadata.file_name"))
    if with_ord:
        df = with_positions(df, "ord").select(*[F.col(f"`{c}`") for c in (*cols, "ord", *df.columns[len(cols):])])
    if missing == "pandas":
        df = df.select(*[T.na_to_null(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, T_.StringType) else F.col(f"`{f.name}`")
                         for f in df.schema.fields])
    return df


def _no_rows(spark: SparkSession, schema: T_.StructType | str, with_file: bool, with_ord: bool) -> DataFrame:
    """What ``read_csv`` gives for no file at all."""
    df = spark.createDataFrame([], schema)
    if with_ord:
        df = df.withColumn("ord", F.lit(None).cast("long"))
    for c in ("file_path", "file") if with_file else ():
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, **options) -> None:
    """K1/K2: one distributed write; CSV keeps whitespace and writes '' for missing."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("quote", '"').option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(path)


# ---- Keyword export (S2, P1, P2) -----------------------------------------

def clean_header_name(name: str) -> str:
    """P2 for one name, by the rule of ``text.unquote``; then the export's own column names."""
    bare = re.sub(r"[\x00\ufeff]", "", name).strip()
    return HEADER_NAMES.get(inner := re.sub(r'(?s)\A"(.*)"\Z', r"\1", bare), inner)


def clean_header(df: DataFrame) -> DataFrame:
    """Header only (metadata); cell values untouched."""
    return df.toDF(*[clean_header_name(c) for c in df.columns])


def prune_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """P1 + P5: keep-list in order; raise listing what is missing."""
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise KeyError(f"the export lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{c}`") for c in keep])


def read_keyword_export(spark: SparkSession, paths: str | Sequence[str],
                        include_intents: bool = True, line_sep: str = "\n", with_ord: bool = False) -> DataFrame:
    """Tab-separated UTF-16-LE export with BOM and a messy header.

    Splittable: with ``lineSep`` fixed the reader splits files across tasks.
    Values are read as strings; ``Volume`` / ``ID`` are cast with ``try_cast``.
    With CRLF line ends, the carriage return is taken off the last column.
    ``with_ord`` adds ``ord``, the row's position in the files.
    """
    df = (spark.read.option("header", True).option("sep", "\t").option("encoding", "UTF-16LE")
          .option("lineSep", line_sep).option("quote", '"').option("escape", '"')
          .csv(paths if isinstance(paths, str) else list(paths)))
    keep = EXPORT_KEEP + ([EXPORT_INTENTS] if include_intents else [])
    last = clean_header_name(df.columns[-1])
    names = [clean_header_name(c) for c in df.columns]
    if with_ord:
        df, names, keep = with_positions(df, "ord"), [*names, "ord"], [*keep, "ord"]
    df = df.toDF(*names)
    df = df.withColumn(last, F.regexp_replace(F.col(f"`{last}`"), r"\r\z", ""))
    out = prune_columns(df, keep)
    return out.withColumn("ID", F.col("ID").try_cast("long")) \
              .withColumn("Volume", F.col("Volume").try_cast("long"))


# ---- Parquet bitext and benchmarks (S3, S6, P9, P10) ------------------------

def flatten_bitext(df: DataFrame, src: str = "de", tgt: str = "en",
                   col: str = "translation") -> DataFrame:
    """``translation`` (struct or map) -> source/target, missing key -> ''."""
    dt = df.schema[col].dataType
    if isinstance(dt, T_.MapType):
        get = lambda k: F.coalesce(F.try_element_at(F.col(col), F.lit(k)), F.lit(""))
    else:
        names = set(dt.fieldNames())
        get = lambda k: F.coalesce(F.col(f"{col}.{k}"), F.lit("")) if k in names else F.lit("")
    return df.withColumn("source", get(src)).withColumn("target", get(tgt)).drop(col)


def parse_dict_literal(c, malformed: str = "null") -> Column:
    """P10: Python dict-literal text -> map<string,string>.

    ``\\xNN`` escapes and bare ``None`` values are read as Python writes them.
    Malformed text gives null, for the caller to reject, or with
    ``malformed='raise'`` an error.
    """
    c = T._c(c)
    text = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    # strings are passed over whole, so only a None outside them is replaced
    none = r"""\G((?:[^'"N]++|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")*+)None"""
    text = F.when(text.contains("None"), F.regexp_replace(text, none, "$1null")).otherwise(text)
    parsed = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE",
                                                      "allowBackslashEscapingAnyCharacter": "true"})
    if malformed == "raise":
        return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("no dict literal: "), c))).otherwise(parsed)
    return parsed


def read_aligned_benchmark(spark: SparkSession, path: str, src_code: str, tgt_code: str,
                           split: str = "devtest", max_samples: int = 0) -> DataFrame:
    """Partitioned Parquet (``split=``) of wide rows ``sentence_<code>``.

    The split filter prunes partitions; the projection prunes columns.
    """
    df = spark.read.parquet(path).where(F.col("split") == split)
    out = df.select("ord", F.col(f"sentence_{src_code}").alias("source"),
                    F.col(f"sentence_{tgt_code}").alias("target"))
    return out.orderBy("ord").limit(max_samples) if max_samples and max_samples > 0 else out


# ---- Schema alternatives (P3, P4, P7) --------------------------------------

def harmonise_pair(df: DataFrame) -> DataFrame:
    """(source, target) as is; (input, target) renamed; else error."""
    cols = set(df.columns)
    if {"source", "target"} <= cols:
        return df
    if {"input", "target"} <= cols:
        return df.withColumnRenamed("input", "source")
    raise KeyError(f"a pair table needs target and one of source or input, not {sorted(cols)}")


def target_term_column(df: DataFrame) -> str:
    """``target_norm`` when present, else ``target``."""
    return "target_norm" if "target_norm" in df.columns else "target"


def read_pair_csv(spark: SparkSession, paths, missing: str = "null", **kw) -> DataFrame:
    """A pair CSV in either layout, harmonised to source/target."""
    return harmonise_pair(read_csv(spark, paths, missing=missing, **kw))


# ---- Positions (P8) ---------------------------------------------------------

def positional_id(df: DataFrame, order: Iterable, col: str = "id",
                  checkpoint: bool = True) -> DataFrame:
    """Dense 0..n-1 positions in a total ``order``, computed distributed.

    Range-partitioned sort (balanced by sampling, so a hot value spreads),
    then each row's position = rows in earlier partitions + its index
    inside its partition. Only the per-partition counts (one row per
    partition) are aggregated centrally. The sorted frame is check-pointed
    to the shared checkpoint folder so both passes see the same rows.
    """
    from ..session import checkpoint_root
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        checkpoint_root(df.sparkSession)
        s = s.checkpoint(eager=True)
    s = s.withColumn("_pid", F.shiftright(F.col("_mid"), 33)) \
         .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = s.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
    return out.withColumn(col, (F.col("_off") + F.col("_idx")).cast("long")) \
              .drop("_mid", "_pid", "_idx", "_off")


def add_id_if_absent(df: DataFrame, order: Iterable | None = None, col: str = "id") -> DataFrame:
    """A positional ``id`` only when the input has none.

    A fresh file scan gets its rows' places in the files; with ``order``, any
    frame gets positions in that total order (a distributed sort).
    """
    if col in df.columns:
        return df
    return with_positions(df, col) if order is None else positional_id(df, order, col)


def file_parts(c) -> tuple[Column, Column]:
    """(basename, derived ``{stem}_clean{ext}`` name) of a path column."""
    return T.basename(c), T.clean_suffix_name(T.basename(c))
