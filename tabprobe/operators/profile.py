"""Column profiling.

Cost on an n-row, m-column table: one statistics pass, one distinct count over the unpivoted
values as fixed-width keys (map-side combined; nothing is written), a few passes over the raw
numeric columns for exact medians, and one value count of the other columns when the top
values are read. Each small answer runs only the parts it shows. Only one row per column
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import as_text, col, fixed_width, is_fractional, is_numeric, safe_round, type_name
from tabprobe.functions.quantiles import QUARTILES, median_ranks, nearest_rank, order_statistics
from tabprobe.functions.stats import column_stats
from tabprobe.functions.values import top_values, top_values_array

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
])


def distinct_keys(df: DataFrame) -> DataFrame:
    """(position, k1, k2, d): the distinct non-null values of every column as fixed-width keys.

    Integers and instants are their own 64 bits, floats a double; text, decimals and nested values
    (as JSON) are two 64-bit hashes. One pass with map-side aggregation, so a repeated value
    leaves each task once and no row carries a whole cell.
    """
    parts = []
    for i, f in enumerate(df.schema.fields):
        c, k1, k2, d = col(f.name), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("double")
        if is_fractional(f.dataType):
            d = c.cast("double")
        elif is_numeric(f.dataType) and not isinstance(f.dataType, T.DecimalType):
            k1 = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            k1 = F.unix_micros(c)
        else:
            key = c if isinstance(f.dataType, T.BinaryType) else as_text(c, f.dataType)
            k1, k2 = F.xxhash64(key), F.xxhash64(F.lit(7), key)
        parts.append(F.struct(F.when(c.isNotNull(), F.lit(i)).alias("position"), k1.alias("k1"), k2.alias("k2"), d.alias("d")))
    return df.select(F.inline(F.array(*parts))).where("position is not null").select("position", "k1", "k2", "d").distinct()


def distinct_counts(df: DataFrame) -> dict[str, int]:
    """Distinct non-null values of every column."""
    if not df.columns:
        return {}
    found = distinct_keys(df).groupBy("position").agg(F.count(F.lit(1)).alias("n")).collect()
    return {df.columns[r["position"]]: r["n"] for r in found}


def profile(df: DataFrame, top_n: int = 10, exact: bool = True, stats: dict | None = None,
            quartiles: bool = False, medians: bool = True, tops: bool = True) -> DataFrame:
    """One row per column: name, dtype, null_count, null_pct, unique_count, mean,
    median, std, min, max, top_values, position.

    Numeric columns get the five statistics (rounded to 4 places); the others get
    their ``top_n`` most frequent non-null values as text. ``unique_count`` counts
    null as one value.

    ``exact=False`` counts distinct values with HyperLogLog in the statistics pass.
    ``medians=False`` and ``tops=False`` leave those columns null and skip their passes.
    ``stats`` takes the result of ``column_stats`` when the caller already has it; the collected
    statistics are kept on the result as ``.stats``. ``quartiles=True`` refines the
    nearest-rank quartile ranks in the same passes as the medians; every refined
    rank is kept on the result as ``.order_stats`` for ``eda.numeric_moments``.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    if stats is None or not exact:
        stats = column_stats(df, exact)
    num = [f.name for f in fields if is_numeric(f.dataType)]
    cat_cols = [f.name for f in fields if not is_numeric(f.dataType)]
    med_ranks = {c: list(median_ranks(stats[c]["n"])) for c in num if stats[c]["n"] > 0}
    wanted = {c: sorted({*r, *(nearest_rank(stats[c]["n"], q) for q in QUARTILES)}) if quartiles else r
              for c, r in med_ranks.items()} if medians else {}
    found = order_statistics(df, wanted, stats=stats)
    distinct = distinct_counts(df) if exact else {c: stats[c]["approx_unique"] for c in stats}

    rows = []
    for i, f in enumerate(fields):
        s = stats[f.name]
        row = [i, f.name, type_name(f.dataType), s["nulls"], s["n_rows"], None, None, None, None, None,
               int(distinct.get(f.name, 0) or 0) + (1 if s["nulls"] > 0 else 0)]
        if f.name in med_ranks:
            lo, hi = med_ranks[f.name]
            med = (found[f.name][lo] + found[f.name][hi]) / 2.0 if medians else None
            row[5:10] = [s["mean"], med, s["std"], s["min"], s["max"]]
        rows.append(row)
    base = spark.createDataFrame(rows, PROFILE_SCHEMA)
    top_type = "array<struct<value:string,count:bigint>>"
    if tops and cat_cols:
        listed = top_values_array(top_values(df, cat_cols, top_n))
        out = base.alias("b").join(listed.alias("t"), F.col("b.name") == F.col("t.column_name"), "left")
    else:
        out = base.withColumn("top_values", F.lit(None).cast(top_type)).alias("b")
    listed = F.when(F.col("b.name").isin(cat_cols), F.coalesce(F.col("top_values"), F.array().cast(top_type))) if tops \
        else F.col("top_values")
    result = out.select(
        F.col("b.name").alias("name"),
        F.col("b.dtype").alias("dtype"),
        F.col("b.null_count").alias("null_count"),
        F.round(F.coalesce(F.try_divide(F.col("b.null_count") * F.lit(100.0), F.col("b.n_rows")), F.lit(0.0)), 2).alias("null_pct"),
        F.col("b.unique_count").alias("unique_count"),
        safe_round(F.col("b.mean")).alias("mean"),
        safe_round(F.col("b.median")).alias("median"),
        safe_round(F.col("b.std")).alias("std"),
        safe_round(F.col("b.min")).alias("min"),
        safe_round(F.col("b.max")).alias("max"),
        listed.alias("top_values"),
        F.col("b.position").alias("position"),
    )
    result.stats = stats
    result.order_stats = found
    return result


def memory_estimate(df: DataFrame) -> DataFrame:
    """One row ``estimated_bytes`` = fixed width x rows + UTF-8 bytes of the rest."""
    parts = []
    for f in df.schema.fields:
        c = col(f.name)
        width = fixed_width(f.dataType)
        if width is not None:
            parts.append(F.count(F.lit(1)) * F.lit(width))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)))
        else:
            parts.append(F.coalesce(F.sum(F.octet_length(F.to_json(c))), F.lit(0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(total.cast("long").alias("estimated_bytes"))


def column_split(df: DataFrame) -> DataFrame:
    """How many numeric and how many other columns; the schema alone tells."""
    n = sum(is_numeric(f.dataType) for f in df.schema.fields)
    return df.sparkSession.createDataFrame([(n, len(df.columns) - n)], "n_numeric bigint, n_categorical bigint")


def quick_profile(df: DataFrame) -> DataFrame:
    """The printed table of the quick profile command: statistics and unique counts only."""
    return profile(df, medians=False, tops=False).select("name", "dtype", "null_count", "unique_count", "mean", "min", "max")


def cardinality(df: DataFrame) -> DataFrame:
    """Unique count per field (null counts as one), the data behind the cardinality bar chart."""
    distinct = distinct_counts(df)
    nulls = df.agg(*[F.coalesce(F.max(col(c).isNull().cast("int")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.sparkSession.createDataFrame([(c, distinct.get(c, 0) + nulls[i]) for i, c in enumerate(df.columns)],
                                           "name string, unique_count bigint")
