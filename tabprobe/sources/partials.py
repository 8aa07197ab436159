"""Mergeable column statistics by input file: after files are added, only those are scanned.

Each file leaves one small row a column: row and null counts, mean, sum of squared deviations, extremes and
a distinct-count sketch. Rows of all files of the present listing merge into the statistics of the
whole input, so added files are scanned alone, changed ones again, and removed ones are left out.

Layout: ``{root}/partials-{key}/batch-*``, one Parquet folder for each scan, ``key`` by path, schema and reader options.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.functions.exprs import as_text, col, is_fractional, is_numeric, safe_round, type_name
from tabprobe.sources import readers

# 2^14 registers: a standard error of 0.8 %.
SKETCH_BITS = 14
STATE = ("file string, stamp string, position int, n_rows bigint, nulls bigint, mean double, m2 double, n bigint, min double, "
         "max double, sketch binary")


def file_states(df: DataFrame) -> DataFrame:
    """(file, position, statistics) of each input file and column of ``df``, a table read from files.

    One pass over unpivoted columns with map-side aggregation; a task keeps a row for each of its
    files and columns.
    """
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        v = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        if is_fractional(f.dataType):
            key = F.xxhash64(F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c.cast("double") + F.lit(0.0)))  # one NaN, one zero
        elif is_numeric(f.dataType):
            key = F.xxhash64(c)
        else:
            key = F.xxhash64(as_text(c, f.dataType))
        parts.append(F.struct(F.lit(i).alias("position"), c.isNull().alias("isnull"), v.alias("v"), F.when(c.isNotNull(), key).alias("key")))
    v = F.col("v")
    return (df.select(F.col("_metadata.file_path").alias("file"), F.array(*parts).alias("cells")).select("file", F.inline("cells"))
            .groupBy("file", "position").agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if("isnull").alias("nulls"), F.avg(v).alias("mean"),
                (F.var_pop(v) * F.count(v)).alias("m2"), F.count(v).alias("n"), F.min(v).alias("min"),
                F.max(F.when(~F.isnan(v), v)).alias("max"), F.hll_sketch_agg("key", SKETCH_BITS).alias("sketch")))


def merge_states(states: DataFrame) -> DataFrame:
    """One row per position: the statistics of all files together."""
    total = states.groupBy("position").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("total"),
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("grand"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_unique"))
    # Squared deviations about the common mean, from each file's own mean, so large means cancel nothing.
    spread = (states.join(total.select("position", "grand"), "position").groupBy("position")
              .agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("m2")))
    return total.join(spread, "position").select(
        "position", "n_rows", "nulls", F.col("grand").alias("mean"),
        F.when(F.col("total") > 1, F.sqrt(F.col("m2") / (F.col("total") - 1))).alias("std"), "min", "max", "approx_unique")


def _batches(spark: SparkSession, base: str) -> list[str]:
    """Folders of finished scans; one that a lost driver left unfinished has no success mark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch-")]
    return sorted(str(f) for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def refresh(spark: SparkSession, path: str, root: str, fmt: str | None = None, reader_options: dict | None = None) -> DataFrame:
    """Statistics of the files under ``path``; only files that ``root`` does not know yet are scanned.

    Returns ``position``, ``name``, ``dtype``, ``n_rows``, ``null_count``, ``mean``, ``std``, ``min``, ``max`` (rounded to
    4 places; null for other than numeric columns) and ``approx_unique`` (standard error 0.8 %). A file is known by
    path, length and modification time. Another schema or other reader options begin anew. An
    input without rows gives a row a column with zero counts.
    """
    fmt = fmt or readers.detect_format(spark, path)
    if fmt == "xlsx":
        raise ValueError("workbooks meet by header names and have no state by file")
    options = reader_options or {}
    df = readers.load(spark, path, fmt, **options)
    text = json.dumps([path, fmt, df.schema.jsonValue(), options], sort_keys=True, default=str)
    base = f"{root.rstrip('/')}/partials-{hashlib.md5(text.encode()).hexdigest()[:16]}"
    listing = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.concat_ws("|", F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time")).alias("stamp"))
    known = spark.createDataFrame([], STATE)
    if old := _batches(spark, base):
        known = spark.read.schema(STATE).parquet(*old)
    # Spark's own listing is on the driver too; the new files' names are no more than that.
    new = [tuple(r) for r in listing.join(known.select("file", "stamp"), ["file", "stamp"], "left_anti").collect()]
    if new:
        stamps = spark.createDataFrame(new, "file string, stamp string")
        # Spark leaves the other files unread: the condition is on their names alone.
        fresh = df.where(F.col("_metadata.file_path").isin([f for f, _ in new]))
        states = file_states(fresh).join(stamps, "file")
        # A file without rows leaves a row too, so that it is known.
        none = stamps.select("file", "stamp", F.lit(-1).alias("position"))
        states.unionByName(none, allowMissingColumns=True).write.parquet(f"{base}/batch-{uuid.uuid4().hex}")
        known = spark.read.schema(STATE).parquet(*_batches(spark, base))
    # Two runs at a time may scan a file twice: one row a file and column counts.
    present = known.where("position >= 0").join(listing, ["file", "stamp"], "left_semi").dropDuplicates(["file", "stamp", "position"])
    names = spark.createDataFrame([(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema.fields)], "position int, name string, dtype string")
    merged = names.join(merge_states(present), "position", "left")
    return merged.select("position", "name", "dtype", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(a) for c, a in (("n_rows", "n_rows"), ("nulls", "null_count"))],
                         *[safe_round(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
                         F.coalesce("approx_unique", F.lit(0)).cast("bigint").alias("approx_unique"))
