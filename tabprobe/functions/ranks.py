"""Average ranks of every distinct value, computed without a per-column single task.

The value-count table (column, value, count) is range-partitioned on (column, value)
and sorted inside each partition; a vectorised pass over each partition (pandas on
the Arrow batches, in partition order) adds the running count of smaller values of
the same column within that partition and the partition number. That table is
written to the checkpoint folder, which fixes the partition assignment. Partition
offsets per column come from a table of one row per (column, partition), at most
columns + partitions rows, broadcast back. The average rank of a value repeated
``cnt`` times after ``before`` smaller values is before + (cnt+1)/2.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.exprs import col
from tabprobe.session import materialize

BLOCK_SCHEMA = "column_name string, value double, cnt long, pid int, local_before long"


def _local_running_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (column_name, value) within one range partition."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    carry_col, carry = None, 0
    for pdf in batches:
        if pdf.empty:
            continue
        before = pdf.groupby("column_name", sort=False)["cnt"].cumsum() - pdf["cnt"]
        first_col = pdf["column_name"].iloc[0]
        if first_col == carry_col:  # the column continues from the previous batch
            before = before + (pdf["column_name"] == first_col) * carry
        last_col = pdf["column_name"].iloc[-1]
        tail = pdf["column_name"] == last_col
        carry = int((before[tail] + pdf["cnt"][tail]).iloc[-1])
        carry_col = last_col
        yield pd.DataFrame({"column_name": pdf["column_name"], "value": pdf["value"], "cnt": pdf["cnt"],
                            "pid": pid, "local_before": before.astype("int64")})


def average_ranks(df: DataFrame, cols: list[str], partitions: int | None = None) -> DataFrame:
    """(column_name, value double, cnt, avg_rank) over the non-null values of ``cols``.

    ``.sizes`` on the result holds the exact distinct count per column (collected:
    one number per column), for callers deciding how to join the ranks back.
    """
    spark = df.sparkSession
    parts = [F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("value")) for c in cols]
    vc = (df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull())
          .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt")))
    # Without an explicit count AQE may coalesce the range partitions; coalesced
    # partitions are contiguous ranges, so partition numbers still follow value order.
    ranged = (vc.repartitionByRange(partitions, "column_name", "value") if partitions
              else vc.repartitionByRange("column_name", "value"))
    blocks = materialize(
        ranged.sortWithinPartitions("column_name", "value")
        .mapInPandas(_local_running_counts, BLOCK_SCHEMA),
        "rank_blocks")
    per_block = blocks.groupBy("column_name", "pid").agg(F.sum("cnt").alias("block_total"),
                                                        F.count(F.lit(1)).alias("block_rows"))
    w = Window.partitionBy("column_name").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("offset", F.coalesce(F.sum("block_total").over(w), F.lit(0))).collect()
    sizes: dict[str, int] = {}
    for r in offsets:
        sizes[r["column_name"]] = sizes.get(r["column_name"], 0) + r["block_rows"]
    # One row per (column, partition): bounded by columns + partitions.
    off = spark.createDataFrame([(r["column_name"], r["pid"], r["offset"]) for r in offsets],
                                "column_name string, pid int, offset long")
    out = (blocks.join(F.broadcast(off), ["column_name", "pid"])
           .select("column_name", "value", "cnt",
                   (F.col("offset") + F.col("local_before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)).alias("avg_rank")))
    out.sizes = sizes
    return out
