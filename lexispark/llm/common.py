"""Shared helpers of the llm operators: table access, stored intermediates, batch size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.session import scratch_path, ship_package

#: Rows that one Arrow batch holds; texts may be long, so far fewer than Spark's default.
BATCH_ROWS = 256


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors and keep Arrow batches small."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list[str | None]], dict], fields: str) -> DataFrame:
    """(doc_id, *fields): ``fn`` turns a batch's texts into columns; ids pass as they are, null or not.

    For other than one row per text, ``fn`` gives under ``at`` the text's place in the batch for each row.
    """
    return map_columns(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                       ["doc_id"], lambda b: fn(b.column("text").to_pylist()), fields)


def map_columns(df: DataFrame, keep: list[str], fn: Callable[[pa.RecordBatch], dict], fields: str) -> DataFrame:
    """The columns ``keep`` of ``df`` and the ``fields`` that ``fn`` makes of each Arrow batch."""
    made = T.StructType.fromDDL(fields)
    types = {f.name: to_arrow_type(f.dataType) for f in made.fields}
    schema = T.StructType([df.schema[c] for c in keep] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            at = out.pop("at", None)
            kept = [b.column(c) if at is None else b.column(c).take(pa.array(at, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(out[n], t) for n, t in types.items()]], [*keep, *types])

    return df.mapInArrow(run, schema)


#: Bits of the bitmap that tells which rows need no shuffle: 8 MB, whatever the number of ids.
ID_BITS = 1 << 26
_ROW_BITS = 32768  # of Spark's bitmap functions


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def parted(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df``'s rows whose id may be among ``ids`` (its first column), and those whose id certainly is not.

    The ids set bits in a bitmap of fixed size, which is broadcast; nothing of
    ``df`` is shuffled. The first part holds some other rows too, the more the
    fuller the bitmap, so what uses it must still compare ids. Null ids are
    in the first part.
    """
    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(ID_BITS)) + 1  # from 1, as the bitmap functions count

    row, bits, at = (fresh(df, n) for n in ("__row", "__bits", "__at"))
    # ID_BITS / 32768 rows of 4 kB
    made = ids.select(bit(F.col(ids.columns[0])).alias("b")).groupBy(F.bitmap_bucket_number("b").alias(row)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias(bits))
    marked = (df.withColumn(row, F.bitmap_bucket_number(bit(F.col(id_col)))).withColumn(at, F.bitmap_bit_position(bit(F.col(id_col))))
              .join(F.broadcast(made), row, "left"))
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False)) | F.col(id_col).isNull()
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``df``'s rows whose id is not among ``ids`` (its first column); only rows that may be are shuffled. Null ids stay."""
    maybe, rest = parted(df, id_col, ids)
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    return rest.unionByName(maybe.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti"))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def sorted_groups(batches: Iterator[pa.RecordBatch], heads: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Of rows sorted by ``heads``: tables and the bounds of the whole groups in them; the last group waits for the next batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for h in heads:
            c = t[h].chunk(0)
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        if len(starts) > 1:
            yield t, list(zip(starts, starts[1:], strict=False))
        held = t.slice(starts[-1])
    if held is not None:
        yield held.combine_chunks(), [(0, held.num_rows)]
