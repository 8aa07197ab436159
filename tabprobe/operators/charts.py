"""Chart-ready tables (V1-V6) and the export.

Drawing is left to the caller; these are the numbers behind each chart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import as_text, col, is_numeric

# Fixed values (as the analysed tool uses them): histogram bins, bars shown, and the sizes at which it
# samples. Nothing here samples by itself: a caller who wants one states its size.
HIST_BINS = 30
BAR_TOP = 15
SCATTER_CAP = 5000
EXPORT_CAP = 50000


@dataclass
class ChartInstruction:
    type: str
    x: str = ""
    y: str = ""
    title: str = ""

    @classmethod
    def from_dict(cls, d: dict) -> "ChartInstruction":
        t = d.get("type", "") or ""
        return cls(t, d.get("x", "") or "", d.get("y", "") or "", d.get("title") or f"{t} chart")


def histogram(df: DataFrame, x: str, bins: int = HIST_BINS) -> DataFrame:
    """V1: (bin, lower, upper, count) for ``bins`` equal-width bins over [min, max]
    of the finite values (a column that is not numeric raises ValueError); the last bin is closed. lo = hi widens to +-0.5.

    Pass 1 is a one-row min/max aggregate (two numbers to the driver); pass 2 is a
    group-by on the bin number, joined to the full list of bins so empty bins show 0.
    """
    spark = df.sparkSession
    if not is_numeric(df.schema[x].dataType):
        raise ValueError(f"histogram of {x!r}: {df.schema[x].dataType.simpleString()} is not numeric")
    v = col(x).cast("double")
    finite = col(x).isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    lohi = df.where(finite).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    schema = "bin int, lower double, upper double, count bigint"
    if lohi["lo"] is None:
        return spark.createDataFrame([], schema)
    lo, hi = lohi["lo"], lohi["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(finite).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = F.lit(hi - lo) / F.lit(bins)
    return (edges.join(counts, "bin", "left")
            .select("bin",
                    F.round(F.lit(lo) + F.col("bin") * width, 4).alias("lower"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * width, 4).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def bar_mean(df: DataFrame, x: str, y: str, top: int = BAR_TOP) -> DataFrame:
    """V2: (label, value) = mean of y per x, non-null keys and means, highest first
    (ties by label), first ``top``."""
    agg = df.groupBy(col(x).alias("label")).agg(F.avg(col(y)).alias("value"))
    return (agg.where(F.col("label").isNotNull() & F.col("value").isNotNull())
            .orderBy(F.desc("value"), F.asc("label")).limit(top)
            .select("label", F.round("value", 4).alias("value")))


def bar_count(df: DataFrame, x: str, top: int = BAR_TOP) -> DataFrame:
    """V3: (label, value) = frequency of each non-null x, most frequent first."""
    return (df.where(col(x).isNotNull()).groupBy(col(x).alias("label")).agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), F.asc("label")).limit(top))


def sample_rows(df: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """The ``size`` rows with the smallest md5 of their ``keys`` (all columns by default) as text, the
    other columns breaking ties: a sample that depends on the rows alone, not on their order or
    partitioning.

    The row count gives a cutoff that slightly more than ``size`` digests fall below, and a second count
    makes sure of it (rows that share their keys share a digest, so it may take a higher one); only rows
    below it are sorted. So the merge sees some ``size`` rows in all, not ``size`` from each task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    order = keys or df.columns
    text = F.concat_ws("|", *[F.coalesce(as_text(col(c), types[c]), F.lit("")) for c in order])
    digest, rows = F.md5(text), df
    n = df.count()
    most = size + 6 * size ** 0.5 + 10
    while n > most:
        below = digest < F.lit(f"{int(most / n * (1 << 128)):032x}")
        if df.where(below).count() >= size:
            rows = df.where(below)
            break
        most *= 4
    return rows.orderBy(digest, *[as_text(col(c), types[c]) for c in df.columns if c not in order]).limit(size)


def scatter(df: DataFrame, x: str, y: str, size: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """V4: (x, y) non-null pairs: all, or a sample of ``size`` rows by ``keys`` (``sample_rows``)."""
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    if size is not None:
        rows = sample_rows(rows.select(*dict.fromkeys([*(keys or []), x, y])), size, keys)
    return rows.select(col(x).alias("x"), col(y).alias("y"))


def chart_data(df: DataFrame, instructions: list, scatter_size: int | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """V5: {title: table} for each valid instruction, and warnings for the others. histogram and
    bar need x in the table, scatter needs x and y. bar without a usable y counts x."""
    out: dict[str, DataFrame] = {}
    warnings: list[str] = []
    for i, d in enumerate(instructions):
        try:
            inst = d if isinstance(d, ChartInstruction) else ChartInstruction.from_dict(d)
            if inst.type == "histogram" and inst.x in df.columns:
                out[inst.title] = histogram(df, inst.x)
            elif inst.type == "bar" and inst.x in df.columns:
                numeric = inst.y and inst.y in df.columns and is_numeric(df.schema[inst.y].dataType)
                out[inst.title] = bar_mean(df, inst.x, inst.y) if numeric else bar_count(df, inst.x)
            elif inst.type == "scatter" and inst.x in df.columns and inst.y in df.columns:
                out[inst.title] = scatter(df, inst.x, inst.y, scatter_size)
            else:
                warnings.append(f"chart {i}: type {inst.type!r} with x {inst.x!r}, y {inst.y!r} skipped")
        except (ValueError, TypeError, AttributeError) as e:
            warnings.append(f"chart {i}: {e}")
    return out, warnings


def export_sample(df: DataFrame, size: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """All rows, or a sample of ``size`` rows by ``keys`` (``sample_rows``)."""
    return df if size is None else sample_rows(df, size, keys)


def render_text(df: DataFrame) -> DataFrame:
    """Every cell as text for a spreadsheet; null becomes '' and nested values JSON."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        t = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        out.append(F.coalesce(t, F.lit("")).alias(f.name))
    return df.select(*out)


def chart_series(sample: DataFrame, inst: ChartInstruction | dict) -> DataFrame | None:
    """V6: the raw x (and y) columns of the exported rows behind one chart."""
    if isinstance(inst, dict):
        inst = ChartInstruction.from_dict(inst)
    if inst.type not in ("histogram", "bar", "scatter") or not inst.x or inst.x not in sample.columns:
        return None
    if inst.y and inst.y in sample.columns:
        return sample.select(col(inst.x), col(inst.y))
    return sample.select(col(inst.x))
