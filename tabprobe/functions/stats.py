"""Per-column statistics of a table in one distributed pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import col, is_fractional, is_numeric

INF = float("inf")


def _numeric_aggs(v: Column, skew: bool = False) -> list[tuple[str, Column]]:
    """(name, aggregate) for a numeric value column."""
    out = [("skewness", F.skewness(v))] if skew else []
    return out + [
        ("mean", F.avg(v)),
        ("std", F.stddev_samp(v)),
        ("min", F.min(v)),
        ("max", F.max(F.when(F.isnan(v), F.lit(None)).otherwise(v))),
        ("nonfinite", F.count_if(F.isnan(v) | (F.abs(v) == F.lit(INF)))),
    ]


def column_stats(df: DataFrame, exact: bool = True, skew: bool = False) -> dict[str, dict]:
    """Row count, nulls and numeric moments of every column in one pass.

    Keys per column: n_rows, nulls, n (non-null), mean, std, min, max, and for the
    order statistics nan, ninf, pinf, fmin, fmax (finite min/max); plus
    approx_unique when ``exact`` is False. The columns are unpivoted and grouped by
    column number with map-side aggregation, so one pass and a buffer of fixed size
    serve a table of any width. Only one row per column reaches the driver.
    """
    out = _long(df, exact, skew)
    fractional = [f.name for f in df.schema.fields if is_fractional(f.dataType) and out[f.name].get("nonfinite")]
    if fractional:
        _nonfinite_detail(df, fractional, out)
    return out


def _finish(r: dict, dt: T.DataType) -> dict:
    r["n"] = r["n_rows"] - r["nulls"]
    if is_numeric(dt):
        r.setdefault("nan", 0)
        r.setdefault("ninf", 0)
        r.setdefault("pinf", 0)
        r.setdefault("fmin", r["min"])
        r.setdefault("fmax", r["max"])
    return r


def _long(df: DataFrame, exact: bool, skew: bool = False) -> dict[str, dict]:
    fields = df.schema.fields
    parts = []
    for i, f in enumerate(fields):
        c = col(f.name)
        v = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        s = [F.lit(i).alias("k"), c.isNull().alias("isnull"), v.alias("v")]
        if not exact:
            s.append(F.xxhash64(c).alias("h"))
        parts.append(F.struct(*s))
    long = df.select(F.inline(F.array(*parts)))
    v = F.col("v")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("isnull")).alias("nulls")]
    aggs += [agg.alias(name) for name, agg in _numeric_aggs(v, skew)]
    if not exact:
        aggs.append(F.approx_count_distinct(F.when(~F.col("isnull"), F.col("h"))).alias("approx_unique"))
    rows = {r["k"]: r.asDict() for r in long.groupBy("k").agg(*aggs).collect()}
    out = {}
    for i, f in enumerate(fields):
        r = rows.get(i)
        if r is None:  # empty input: no group for the column
            r = {"n_rows": 0, "nulls": 0, "mean": None, "std": None, "min": None, "max": None,
                 "nonfinite": 0, "approx_unique": 0}
        r.pop("k", None)
        if not is_fractional(f.dataType):
            r.pop("nonfinite", None)
        out[f.name] = _finish(r, f.dataType)
    return out


def _nonfinite_detail(df: DataFrame, cols: list[str], out: dict[str, dict]) -> None:
    """Second, rare pass: NaN/infinity counts and finite min/max of float columns that have them."""
    exprs = []
    for i, c in enumerate(cols):
        d = col(c).cast("double")
        finite = F.when(F.isnan(d) | (F.abs(d) == F.lit(INF)), F.lit(None)).otherwise(d)
        exprs += [
            F.count_if(F.isnan(d)).alias(f"c{i}__nan"),
            F.count_if(d == F.lit(-INF)).alias(f"c{i}__ninf"),
            F.count_if(d == F.lit(INF)).alias(f"c{i}__pinf"),
            F.min(finite).alias(f"c{i}__fmin"),
            F.max(finite).alias(f"c{i}__fmax"),
        ]
    row = df.agg(*exprs).first().asDict()
    for i, c in enumerate(cols):
        for k in ("nan", "ninf", "pinf", "fmin", "fmax"):
            out[c][k] = row[f"c{i}__{k}"]


def agg_row(df: DataFrame, exprs: list[Column]) -> dict:
    """Collect the one-row result of many aggregates: one job, one scan."""
    return df.agg(*exprs).first().asDict()
