"""Incremental L1 over arriving candidate files (Structured Streaming).

The reference is batch-only; this is the same row-local stage run on a
file stream. Normalisation and the F1-F3 filters are stateless; the
keep-first de-duplication becomes ``dropDuplicates`` on (source,
target_norm): a pair seen in an earlier micro-batch is never emitted again
(within one micro-batch any one duplicate is kept -- exact keep-first by
file position needs the batch ``dedup_keep_first``); the split is the threshold hash split
(membership is fixed per source, so it never moves as data grows).
Top-k per source needs the whole group and stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import split
from ..plans import prepare
from ..session import scratch_path


def prepare_stream(stream: DataFrame, cfg: prepare.PrepConfig = prepare.PrepConfig(),
                   watermark_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Filtered, de-duplicated, split rows of a streaming candidate frame.

    With ``watermark_col`` the dedup state is bounded by the watermark
    (``dropDuplicatesWithinWatermark``); without it, state grows with the
    number of distinct (source, target_norm) pairs.
    """
    f = prepare.filtered(stream, cfg)
    if watermark_col:
        d = f.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark(["source", "target_norm"])
    else:
        d = f.dropDuplicates(["source", "target_norm"])
    return split.threshold_split(d, "source", cfg.train_frac, cfg.seed)


def start_csv_stream(spark: SparkSession, in_dir: str, schema: str, out_dir: str,
                     cfg: prepare.PrepConfig = prepare.PrepConfig(),
                     checkpoint: str | None = None, available_now: bool = True,
                     watermark_col: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Read CSV files as they land in ``in_dir``; append Parquet partitioned by split.

    ``watermark_col``, a timestamp column of ``schema``, and ``delay`` bound
    the state as in ``prepare_stream``.

    The checkpoint lives in the shared checkpoint folder, so a restarted
    driver (or lost executors) resume exactly where the last batch ended.
    """
    src = (spark.readStream.schema(schema).option("header", True).option("quote", '"')
           .option("escape", '"').csv(in_dir))
    out = prepare_stream(src, cfg, watermark_col, delay)
    w = (out.writeStream.format("parquet").outputMode("append").partitionBy("split")
         .option("path", out_dir)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
