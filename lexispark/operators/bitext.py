"""Bitext records: prompt templating and positional zip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_


def _text(c: Column, dt: T_.DataType, any_missing: bool, missing: str) -> Column:
    """A cell as pandas would print it: a numeric column holding a missing
    value prints as float (``590.0``); missing prints ``nan`` in pandas mode."""
    if isinstance(dt, (T_.IntegerType, T_.LongType, T_.ShortType)) and any_missing:
        s = F.when(c.isNotNull(), F.format_string("%.1f", c.cast("double")))
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit("nan")) if missing == "pandas" else s


def keyword_template(df: DataFrame, include_intents: bool = True, missing: str = "null",
                     volume_has_missing: bool = False) -> Column:
    """``Keyword: k | Volume: v | SERP: s[ | Intents: i]``.

    Under ``missing='null'`` a null field drops out (``concat_ws`` skips
    nulls); ``missing='pandas'`` prints ``nan``. ``volume_has_missing``
    reproduces the float print of a numeric column holding a missing value
    (known from the scan's null count, not computed here).
    """
    sch = df.schema
    parts = [("Keyword: ", "Keyword"), ("Volume: ", "Volume"), ("SERP: ", "SERP Features")]
    if include_intents:
        parts.append(("Intents: ", "Intents"))
    cols = []
    for label, name in parts:
        v = _text(F.col(f"`{name}`"), sch[name].dataType, name == "Volume" and volume_has_missing,
                  missing)
        cols.append(F.concat(F.lit(label), v))
    return F.concat_ws(" | ", *cols)


def build_parallel(src: DataFrame, tgt: DataFrame, include_intents: bool = True,
                   by: str = "ord", missing: str = "null") -> DataFrame:
    """Pair two exports' rows -> (input, target).

    ``by`` is what pairs them: ``ord``, the rows' positions as the readers
    give them, or a key that both sides carry, such as ``ID``. The keys go to
    a hash join of both sides, which sorts neither. A row without partner is
    an error when it is met, so no side is counted beforehand; keys that
    repeat on a side are one too. In pandas mode one aggregate over the source
    first finds whether ``Volume`` has a missing value and so prints as float.
    """
    for df in (src, tgt):
        if by not in df.columns:
            raise KeyError(f"no column {by} to pair by; the table has {', '.join(df.columns)}")
    as_float = missing == "pandas" and not src.where(F.col("Volume").isNull()).isEmpty()
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{by} repeats: "), F.col("_s").cast("string")))
                  .cast("boolean")).otherwise(True)
    s = src.select(F.col(by).alias("_s"), keyword_template(src, include_intents, missing, as_float).alias("input"))
    t = tgt.select(F.col(by).alias("_s"), F.col("Keyword").alias("target"))
    if by != "ord":  # positions are unique as made
        s, t = (d.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), F.first(c).alias(c)).where(once).drop("_n")
                for d, c in ((s, "input"), (t, "target")))
    s, t = s.withColumn("_in", F.lit(True)), t.withColumnRenamed("_s", "_t").withColumn("_tin", F.lit(True))
    met = s.join(t.hint("shuffle_hash"), F.col("_s") == F.col("_t"), "full")
    alone = F.raise_error(F.concat(F.lit(f"no partner for the row of {by} "),
                                   F.coalesce(F.col("_s"), F.col("_t")).cast("string"))).cast("boolean")
    return met.where(F.when(F.col("_in") & F.col("_tin"), True).otherwise(alone)).select("input", "target")
