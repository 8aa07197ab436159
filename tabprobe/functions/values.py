"""Value counts and most frequent values of many columns at once.

Cells become rows of fixed width (column, 128-bit key, head of the text); ``groupBy`` with its
map-side partial aggregation collapses repeated values before the shuffle, so a hot value costs one
row per map task, not one row per occurrence, and a long text never crosses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.exprs import as_text, col
from tabprobe.session import materialize

#: Characters of a value that travel with its key: enough to order most values.
HEAD = 32
#: Keys (24 bytes each) that may be sent to every task to fetch their texts; beyond, Spark joins by shuffling.
FETCH = 100_000


def long_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value) with the value rendered as text, nulls dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [f"_v{i}" for i in range(len(cols))]
    wide = df.select(*[as_text(col(c), types[c]).alias(k) for c, k in zip(cols, keys)])
    out = wide.unpivot([], keys, "_k", "value").where(F.col("value").isNotNull())
    mapping = F.create_map(*[x for k, c in zip(keys, cols) for x in (F.lit(k), F.lit(c))])
    return out.select(mapping[F.col("_k")].alias("column_name"), "value")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, count) over the non-null values of ``cols``."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count bigint")
    return long_text(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def _keys(df: DataFrame, cols: list[str], keep: dict[str, Column] | None, *more: str) -> DataFrame:
    """One row per non-null cell: position, 128-bit key, and by name: head (the first ``HEAD`` characters
    of its text), longer (whether the text goes on), value (all of it)."""
    types, parts = {f.name: f.dataType for f in df.schema.fields}, []
    for i, c in enumerate(cols):
        text = as_text(col(c), types[c])
        if keep is not None:
            text = F.when(keep[c], text)
        made = {"head": F.substring(text, 1, HEAD), "longer": F.char_length(text) > HEAD, "value": text}
        parts.append(F.struct(F.when(text.isNotNull(), F.lit(i)).alias("position"), F.xxhash64(text).alias("k1"),
                              F.xxhash64(F.lit(7), text).alias("k2"), *[made[m].alias(m) for m in more]))
    return df.select(F.inline(F.array(*parts))).where("position is not null")


def top_values(df: DataFrame, cols: list[str], k: int = 10, keep: dict[str, Column] | None = None) -> DataFrame:
    """(column_name, rank, value, count): the ``k`` most frequent non-null values of each column as
    text, ties broken by the lower value. ``keep``: a condition per column for the rows that count.

    Cells are counted by 128-bit key and head, so no long text crosses the shuffle. Values up to ``HEAD`` characters
    are their own heads. Where a longer one is among the winners, or ties with the last by count
    and head, only the texts of those keys are fetched, each task sending one copy of each.
    """
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, rank int, value string, count bigint")
    by_key = ["position", "k1", "k2", "head", "longer"]
    counts = _keys(df, cols, keep, "head", "longer").groupBy(*by_key).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("head"))
    # rank(), not row_number(): what ties with the last by count and head stays until its text is known.
    near = counts.withColumn("place", F.rank().over(w)).where(F.col("place") <= k).drop("place")
    near = materialize(near, "top_keys")
    n_long = near.where("longer").count()
    if n_long:
        wanted = near.where("longer").select("position", "k1", "k2")
        wanted = F.broadcast(wanted) if n_long <= FETCH else wanted
        texts = (_keys(df, cols, keep, "value").join(wanted, ["position", "k1", "k2"], "left_semi")
                 .groupBy("position", "k1", "k2").agg(F.min("value").alias("value")))
        near = near.join(texts, ["position", "k1", "k2"], "left").withColumn("value", F.coalesce("value", "head"))
    else:
        near = near.withColumn("value", F.col("head"))
    last = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"))
    names = F.array(*[F.lit(c) for c in cols])
    return (near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select(F.element_at(names, F.col("position") + 1).alias("column_name"), "rank", "value", "count"))


def top_values_array(top: DataFrame) -> DataFrame:
    """(column_name, top_values array<struct<value,count>>) in rank order (<= k rows each)."""
    return top.groupBy("column_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
            lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")),
        ).alias("top_values")
    )
