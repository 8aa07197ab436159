"""The result store (S7-S9, S13): cleaned table and result tables as Parquet.

Layout: ``{root}/{key}/{stage}/t{i}/`` where ``key`` is the input fingerprint plus
a hash of the options, so a cache written by one stage or with other options is
never taken for another (a profile-only cache cannot stand in for a full run).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(fingerprint: str, stage: str, options: dict | None = None) -> str:
    opts = json.dumps(options or {}, sort_keys=True, default=str)
    return f"{fingerprint}-{hashlib.md5(opts.encode()).hexdigest()[:12]}/{stage}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def save(root: str, key: str, tables: dict[str, DataFrame], notes: dict | None = None) -> str:
    """Write every table; the ``_complete`` marker (with the table names and ``notes``, any JSON) is
    written last, so a half-written entry is never read back."""
    base = f"{root.rstrip('/')}/{key}"
    spark = None
    for i, df in enumerate(tables.values()):
        df.write.mode("overwrite").parquet(f"{base}/t{i}")
        spark = df.sparkSession
    if spark is not None:
        text = json.dumps({"tables": list(tables), "notes": notes or {}})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_complete")
    return base


def load(spark: SparkSession, root: str, key: str) -> tuple[dict[str, DataFrame], dict] | None:
    """The stored tables and notes, or None when the entry is missing or incomplete."""
    base = f"{root.rstrip('/')}/{key}"
    if not _exists(spark, f"{base}/_complete"):
        return None
    entry = json.loads(spark.read.text(f"{base}/_complete").first()["value"])
    return {n: spark.read.parquet(f"{base}/t{i}") for i, n in enumerate(entry["tables"])}, entry["notes"]


def profile_records(prof: DataFrame) -> DataFrame:
    """One JSON text per column with the 11 profile fields."""
    fields = ["name", "dtype", "null_count", "null_pct", "unique_count", "mean", "median", "std", "min", "max",
              "top_values"]
    return prof.select(F.col("name"), F.to_json(F.struct(*[F.col(f) for f in fields])).alias("record"))
