"""Exploratory statistics.

Every result is a tidy DataFrame with one row per column (or per column pair).
Numeric work is: one statistics pass, the exact order-statistic passes, and (for
outliers) one counting pass with the bounds as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import col, is_numeric, safe_round
from tabprobe.functions.quantiles import QUARTILES, median_ranks, nearest_rank, order_statistics
from tabprobe.functions.ranks import average_ranks
from tabprobe.functions.stats import agg_row, column_stats
from tabprobe.functions.values import top_values
from tabprobe.session import materialize

# Columns whose cross sums a task holds at once: four matrices of doubles, 32 MB.
WIDTH = 1024

SUMMARY_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("q25", T.DoubleType()),
    T.StructField("q50", T.DoubleType()),
    T.StructField("q75", T.DoubleType()),
    T.StructField("skew", T.DoubleType()),
])


def _numeric_cols(df: DataFrame, cols: list[str] | None) -> list[str]:
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return [c for c in names if cols is None or c in cols]


def numeric_moments(df: DataFrame, cols: list[str] | None = None, stats: dict | None = None,
                    order_stats: dict | None = None) -> dict[str, dict]:
    """Collected per-column statistics plus exact median and nearest-rank quartiles.

    ``stats`` may carry ``column_stats(df, skew=True)`` already computed by the
    caller; ``order_stats`` values already refined at the wanted ranks (the profile's
    ``.order_stats`` with ``quartiles=True``), which skips the refinement.
    """
    cols = _numeric_cols(df, cols)
    if not cols:
        return {}
    sub = df.select(*[col(c) for c in cols])
    if stats is None or any("skewness" not in stats.get(c, {}) for c in cols):
        stats = column_stats(sub, skew=True)
    stats = {c: dict(stats[c]) for c in cols}
    ranks = {}
    for c in cols:
        n = stats[c]["n"]
        ranks[c] = sorted({*median_ranks(n), *(nearest_rank(n, q) for q in QUARTILES)}) if n else []
    if order_stats is not None and all(set(ranks[c]) <= set(order_stats.get(c, {})) for c in cols):
        values = order_stats
    else:
        values = order_statistics(sub, ranks, stats=stats)
    for c in cols:
        s, n = stats[c], stats[c]["n"]
        if n == 0:
            continue
        v = values[c]
        lo, hi = median_ranks(n)
        s["median"] = (v[lo] + v[hi]) / 2.0
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            s[name] = float(v[nearest_rank(n, q)])
        sd = s["std"]
        # mean((x-mean)^3) / s^3 with the sample s: Spark's skewness uses the
        # population s, so rescale by ((n-1)/n)^1.5. Undefined for s null or 0.
        s["skew"] = (s["skewness"] * ((n - 1) / n) ** 1.5
                     if sd not in (None, 0.0) and s["skewness"] is not None else None)
    return stats


def numeric_summary(df: DataFrame, cols: list[str] | None = None, moments: dict | None = None) -> DataFrame:
    """Mean, median, std, min, max, q25, q50, q75, skew per numeric
    column, rounded to 4 places, NaN as null; all-null columns are left out."""
    cols = _numeric_cols(df, cols)
    m = moments if moments is not None else numeric_moments(df, cols)
    rows = []
    for i, c in enumerate(cols):
        s = m.get(c)
        if not s or s["n"] == 0:
            continue
        rows.append((c, i, s["n"], s["mean"], s["median"], s["std"], s["min"], s["max"],
                     s["q25"], s["q50"], s["q75"], s["skew"]))
    base = df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)
    return base.select("column_name", "position", "n",
                       *[safe_round(F.col(k)).alias(k) for k in
                         ("mean", "median", "std", "min", "max", "q25", "q50", "q75", "skew")])


def categorical_summary(df: DataFrame, top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(column_name, unique_count) of non-null values, and the top values
    (column_name, rank, value, count) per non-numeric column."""
    cols = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    spark, schema = df.sparkSession, "column_name string, unique_count bigint"
    if not cols:
        return spark.createDataFrame([], schema), top_values(df, [], top_n)
    from tabprobe.operators.profile import distinct_counts

    distinct = distinct_counts(df.select(*[col(c) for c in cols]))
    # A column whose values are all null still has a row with 0.
    uniq = spark.createDataFrame([(c, distinct.get(c, 0)) for c in cols], schema)
    return uniq, top_values(df, cols, top_n)


def _column_groups(k: int) -> list[list[int]]:
    """Groups of at most ``WIDTH`` columns of which one holds any two columns."""
    if k <= WIDTH:
        return [list(range(k))]
    half = WIDTH // 2
    blocks = [list(range(at, min(at + half, k))) for at in range(0, k, half)]
    return [p + q for n, p in enumerate(blocks) for q in blocks[n + 1:]]


def _cross_sums(data: DataFrame, cols: list[str], shift: list[float]):
    """Four k x k matrices over the rows where both columns are present, of values less ``shift``:
    rows, sums of the first column, sums of its squares, sums of products.

    One pass for each group of columns (one group up to ``WIDTH`` columns): a task adds up its batches as
    matrix products and emits the matrices once, and they are summed cell by cell with map-side
    aggregation. The passes read only their columns. 4 k^2 numbers reach the driver, as many as the
    result has in order.
    """
    import numpy as np

    out = np.zeros((4, len(cols), len(cols)))
    for group in _column_groups(len(cols)):
        out[np.ix_(range(4), group, group)] = _group_sums(data, [cols[i] for i in group], [shift[i] for i in group])
    return out


def _group_sums(data: DataFrame, cols: list[str], shift: list[float]):
    import numpy as np

    k = len(cols)
    values = data.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def run(batches):
        import pyarrow as pa

        total = np.zeros((4, k, k))
        with np.errstate(all="ignore"):
            for batch in batches:
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
                present = np.stack([~np.asarray(batch.column(i).is_null()) for i in range(k)], axis=1)
                x = np.where(present, x - shift, 0.0)
                w = present.astype(float)
                total += np.stack([w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(range(4 * k * k), pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

    sums = values.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(4 * k * k)
    flat[sums.column("cell").to_numpy()] = sums.column("v").to_numpy()
    return flat.reshape(4, k, k)


def _coefficients(n, s, ss, xy):
    """Correlations from the cross sums; NaN where a column is constant on a pair's rows (no more than
    rounding is left) or the pair has none."""
    import numpy as np

    with np.errstate(all="ignore"):
        var = ss / n - (s / n) ** 2
        cov = xy / n - s / n * (s / n).T
        varies = var > 1e-13 * (ss / n)
        r = np.clip(cov / np.sqrt(var * var.T), -1.0, 1.0)
    r[~(varies & varies.T)] = np.nan
    np.fill_diagonal(r, 1.0)
    return r


def correlation(
    df: DataFrame,
    cols: list[str] | None = None,
    method: str = "pearson",
    nulls: str = "propagate",
) -> DataFrame:
    """(col_a, col_b, r) for every ordered pair of numeric columns, diagonal
    included, rounded to 4 places; empty with fewer than two numeric columns.

    A constant column gives null. ``nulls="propagate"``: a column
    with any null gives null in its whole row and column; ``"pairwise"``: rows where either side is null are
    skipped for that pair. ``method="spearman"`` correlates average ranks; ranks of a pair's complete rows
    differ from pair to pair, so spearman with pairwise nulls is refused. One statistics pass and one pass
    for the cross sums of up to ``WIDTH`` columns; wider tables take one for each pair of half as wide blocks.
    """
    cols = _numeric_cols(df, cols)
    spark = df.sparkSession
    schema = "col_a string, col_b string, r double"
    if method == "spearman" and nulls == "pairwise":
        raise ValueError("spearman ranks whole columns; pairwise nulls are not supported with it")
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    data = df.select(*[col(c) for c in cols])
    stats = column_stats(data)
    usable = [c for c in cols if stats[c]["n"] > 0 and stats[c]["min"] != stats[c]["max"]
              and (nulls == "pairwise" or stats[c]["nulls"] == 0)]
    rs: dict[tuple[str, str], float | None] = {}
    if usable:
        if method == "spearman":
            data = _with_ranks(data, usable)
            shift = [(stats[c]["n"] + 1) / 2.0 for c in usable]
        else:
            shift = [m if m is not None and abs(m) < float("inf") else 0.0 for m in (stats[c]["mean"] for c in usable)]
        r = _coefficients(*_cross_sums(data, usable, shift)).tolist()
        rs = {(a, b): r[i][j] for i, a in enumerate(usable) for j, b in enumerate(usable)}
    rows = [(a, b, rs.get((a, b))) for a in cols for b in cols]
    return spark.createDataFrame(rows, schema).select("col_a", "col_b", safe_round(F.col("r")).alias("r"))


#: Cells of a shuffle partition, and rows from which a value is hot.
CELLS, HOT = 1_000_000, 100_000


def _with_ranks(data: DataFrame, cols: list[str]) -> DataFrame:
    """Each column's values replaced by their average ranks (columns without nulls).

    The rows get a number and are stored once; one long table (column, value, row) meets the rank
    table in one join, and one regrouping by row puts the ranks side by side: two narrow shuffles for any
    number of columns, in parts of some ``CELLS`` cells. Values of ``HOT`` rows or more, of which there are
    at most cells / ``HOT``, are broadcast and not shuffled by value.
    """
    numbered = materialize(data.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
                           .withColumn("row", F.monotonically_increasing_id()), "numbered")
    shuffle = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, -(-numbered.count() * len(cols) // CELLS))
    ranks = average_ranks(numbered.select(*[F.col(f"v{i}").alias(c) for i, c in enumerate(cols)]), cols, parts)
    on = ["column_name", "value"]
    cells = numbered.select("row", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("value"))
                                                      for i, c in enumerate(cols)])))
    hot = F.broadcast(ranks.where(F.col("cnt") >= HOT).select(*on, "avg_rank"))
    rare = (cells.join(hot, on, "left_anti").repartition(parts, *on)
            .join(ranks.where(F.col("cnt") < HOT).select(*on, "avg_rank").repartition(parts, *on).hint("merge"), on))
    met = cells.join(hot, on).select("row", "column_name", "avg_rank").unionByName(rare.select("row", "column_name", "avg_rank"))
    side = (met.repartition(parts, "row").groupBy("row")
            .agg(*[F.max(F.when(F.col("column_name") == c, F.col("avg_rank"))).alias(c) for c in cols]))
    return side.select(*[col(c) for c in cols])


def outliers(
    df: DataFrame,
    cols: list[str] | None = None,
    method: str = "iqr",
    threshold: float = 1.5,
    moments: dict | None = None,
) -> DataFrame:
    """(column_name, count, pct, lower, upper) per numeric column.

    iqr: outside [q1 - t*iqr, q3 + t*iqr] (strict) with nearest-rank quartiles;
    zscore: |x - mean| / s > t with the sample s. Fewer than 4 values, or s null/0
    for zscore: count 0, pct 0.0, no bounds. pct is of the non-null values.
    """
    cols = _numeric_cols(df, cols)
    spark = df.sparkSession
    if moments is not None:
        m = moments
    elif method == "iqr":
        m = numeric_moments(df, cols)
    else:  # the z-score needs only n, mean and std: no order-statistic passes
        m = column_stats(df.select(*[col(c) for c in cols])) if cols else {}
    bounds = {}
    for c in cols:
        s = m.get(c)
        if not s or s["n"] < 4:
            continue
        if method == "iqr":
            q1, q3 = s["q25"], s["q75"]
            iqr = q3 - q1
            bounds[c] = (q1 - threshold * iqr, q3 + threshold * iqr, None)
        else:
            mean, sd = s["mean"], s["std"]
            if sd is None or sd == 0:
                continue
            bounds[c] = (mean - threshold * sd, mean + threshold * sd, (mean, sd))
    exprs = []
    for i, c in enumerate(cols):
        if c not in bounds:
            continue
        x = col(c).cast("double")
        lo, hi, z = bounds[c]
        if z is None:
            hit = (x < F.lit(lo)) | (x > F.lit(hi))
        else:
            hit = F.abs((x - F.lit(z[0])) / F.lit(z[1])) > F.lit(float(threshold))
        exprs.append(F.count_if(hit & ~F.isnan(x)).alias(f"o{i}"))
    counts = agg_row(df, exprs) if exprs else {}
    rows = []
    for i, c in enumerate(cols):
        n = (m.get(c) or {}).get("n", 0)
        if c in bounds:
            lo, hi, _ = bounds[c]
            rows.append((c, i, counts[f"o{i}"], n, lo, hi))
        else:
            rows.append((c, i, 0, n, None, None))
    base = spark.createDataFrame(rows, "column_name string, position int, count bigint, n bigint, lower double, upper double")
    return base.select(
        "column_name", "position", "count",
        F.when(F.col("n") > 0, F.round(F.col("count") / F.col("n") * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("pct"),
        safe_round(F.col("lower")).alias("lower"),
        safe_round(F.col("upper")).alias("upper"),
    )


def outlier_columns(outl: DataFrame) -> DataFrame:
    """Number of columns with at least one outlier."""
    return outl.agg(F.count_if(F.col("count") > 0).alias("outlier_columns"))
