"""Row positions from a file scan (S1, P8): no sort, no check-point, the same however the scan is split.

The reader numbers the rows of a partition upwards, and a partition holds
whole blocks (file, start, length) one after the other. One aggregate counts
the rows of each block and finds its first number; running sums over the
blocks in (file, start) order then say how many rows come before each. A
row's position is that sum plus its distance from its block's first number:
0 to n-1 in the files' own order. It depends neither on the number of cores
nor on the size of splits, and not on the folder's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks (16 bytes each) that are broadcast; beyond it rows meet their block's sum by a shuffle.
BROADCAST_BLOCKS = 2_000_000


def most_blocks(scan: DataFrame) -> int:
    """An upper bound of the blocks a file scan has, from its file listing; no job."""
    size = int(str(scan._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    conf = scan.sparkSession._jsparkSession.sessionState().conf()
    least = scan.sparkSession.conf.get("spark.sql.files.minPartitionNum", None) or scan.sparkSession.sparkContext.defaultParallelism
    split = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), size // max(1, int(least))))
    return len(scan._jdf.inputFiles()) + -(-size // max(1, split))


def with_positions(scan: DataFrame, col: str = "ord") -> DataFrame:
    """``scan`` with ``col``, each row's position 0..n-1 in the order of its files' paths and of the rows in them.

    ``scan`` must be a file read without row filters. The two scans of the
    plan must cut the same blocks; their lengths are compared, and a row
    without its block's sum is an error, never a wrong position.
    """
    made = {f"_{col}_{n}" for n in ("at", "row")}
    marked = (scan.withColumn(f"_{col}_at", F.xxhash64("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length"))
              .withColumn(f"_{col}_row", F.monotonically_increasing_id()))
    counted = (scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                           F.col("_metadata.file_block_length").alias("size"), F.monotonically_increasing_id().alias("row"))
               .groupBy("path", "start", "size").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")))
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sums = counted.select(F.xxhash64("path", "start", "size").alias("at"),
                          (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    clash = F.raise_error(F.lit("two blocks share a hash")).cast("long")
    sums = sums.groupBy("at").agg(F.min("shift").alias("shift"), F.count(F.lit(1)).alias("n")).select(
        "at", F.when(F.col("n") > 1, clash).otherwise(F.col("shift")).alias("shift"))
    sums = F.broadcast(sums) if most_blocks(scan) <= BROADCAST_BLOCKS else sums
    lost = F.raise_error(F.lit("the files were cut otherwise when their rows were counted; read them again")).cast("long")
    joined = marked.join(sums, marked[f"_{col}_at"] == sums["at"], "left")
    place = F.coalesce(F.col("shift") + F.col(f"_{col}_row"), lost)
    return joined.withColumn(col, place).drop("at", "shift", *made)
