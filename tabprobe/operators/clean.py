"""Cleaning (C1-C14): names -> duplicates -> missing values -> string-to-number casts.

``clean`` returns the cleaned DataFrame (lazy) and the action log as a small
DataFrame. Statistics that decide what to do (null counts, fill values, castability)
are one-row aggregates collected on the driver; the data itself never is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import as_text, col, is_numeric
from tabprobe.functions.names import unique_names
from tabprobe.functions.quantiles import median_ranks, order_statistics
from tabprobe.functions.stats import agg_row
from tabprobe.functions.values import top_values
from tabprobe.session import materialize

ACTION_SCHEMA = "step int, action string, column string, detail string, rows_affected bigint"

# The action log's texts and the constant fill, as the analysed tool
# writes them ({...} are filled in per action).
TEXT_NORMALIZED = "Normalized {renamed} column names to snake_case"
TEXT_DEDUP = "Removed {dropped:,} duplicate rows"
TEXT_DROPPED = "Dropped {n} rows with null '{c}'"
TEXT_FILLED_NUMBER = "Filled {n} nulls in '{c}' with {s} ({v:.2f})"
TEXT_FILLED_VALUE = "Filled {n} nulls in '{c}' with '{v}'"
TEXT_CAST = "Cast '{c}' from String → Float64"
UNKNOWN = "Unknown"
# Our own addition (the analysed tool has no such case).
TEXT_SKIPPED = "Left {n} nulls in '{c}': '{u}' does not fit {t}"

# A number as text: optional sign, digits with an optional point (or a point and
# digits), optional exponent. Leading/trailing spaces, "inf", "nan" and suffixes
# such as "1d" are not numbers here (Spark's cast alone would accept some of them).
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

NUMERIC_STRATEGIES = ("mean", "median", "zero", "drop")
CATEGORICAL_STRATEGIES = ("mode", "unknown", "drop")


@dataclass
class Action:
    action: str
    column: str | None
    detail: str
    rows_affected: int = 0


def actions_frame(spark, actions: list[Action]) -> DataFrame:
    rows = [(i, a.action, a.column, a.detail, int(a.rows_affected)) for i, a in enumerate(actions)]
    return spark.createDataFrame(rows, ACTION_SCHEMA)


# ---------------------------------------------------------------- C1, C2


def normalize_columns(df: DataFrame) -> tuple[DataFrame, Action | None]:
    new = unique_names(df.columns)
    renamed = sum(1 for o, n in zip(df.columns, new) if o != n)
    if renamed == 0:
        return df, None
    out = df.select(*[col(o).alias(n) for o, n in zip(df.columns, new)])
    return out, Action("normalize_columns", None, TEXT_NORMALIZED.format(renamed=renamed), 0)


# ---------------------------------------------------------------- C3


#: Repeated digests (16 bytes each) that may be sent to every task; beyond, whole rows are shuffled.
BROADCAST_DIGESTS = 1_000_000


def _whole_row_distinct(df: DataFrame) -> DataFrame:
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    # MAP values cannot be compared: deduplicate on their JSON text instead.
    keys = [F.to_json(col(c)).alias(f"__k{i}") if c in maps else col(c).alias(f"__k{i}")
            for i, c in enumerate(df.columns)]
    tmp = df.select("*", *keys)
    return tmp.dropDuplicates([f"__k{i}" for i in range(len(df.columns))]).select(*[col(c) for c in df.columns])


def _dedup(df: DataFrame) -> DataFrame:
    """Whole-row distinct, digest first: rows are counted by a 128-bit digest, and only rows of repeated
    digests are shuffled and compared whole. A row whose digest is its own stays where it is.

    Equal rows have equal digests (-0.0 counts as 0.0, NaN as one value), so nothing rests on digests
    of different rows being different. Nested columns may hide floats and go the whole-row way, as do tables
    with more than ``BROADCAST_DIGESTS`` repeated digests, where most of the rows would move anyhow.
    """
    fields = df.schema.fields
    if not fields or any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in fields):
        return _whole_row_distinct(df)
    parts = []
    for f in fields:
        c = col(f.name)
        parts += [c.isNull(), c + F.lit(0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c]
    k1, k2 = F.xxhash64(*parts).alias("__k1"), F.xxhash64(F.lit(7), *parts).alias("__k2")
    repeated = materialize(df.select(k1, k2).groupBy("__k1", "__k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated_digests")
    n = repeated.count()
    if n == 0:
        return df
    if n > BROADCAST_DIGESTS:
        return _whole_row_distinct(df)
    keyed, names = df.select("*", k1, k2), [col(c) for c in df.columns]
    alone = keyed.join(F.broadcast(repeated), ["__k1", "__k2"], "left_anti").select(*names)
    copies = keyed.join(F.broadcast(repeated), ["__k1", "__k2"], "left_semi").select(*names)
    return alone.union(_whole_row_distinct(copies))


def drop_duplicates(df: DataFrame) -> tuple[DataFrame, Action | None]:
    """Whole-row distinct, run once: the result is stored in the checkpoint folder."""
    before = df.count()
    out = materialize(_dedup(df), "deduplicated")
    dropped = before - out.count()
    if dropped == 0:
        return out, None
    return out, Action("drop_duplicates", None, TEXT_DEDUP.format(dropped=dropped), dropped)


# ---------------------------------------------------------------- C4-C11


def _mode_values(df: DataFrame, cols: list[str], keep: dict[str, Column]) -> dict[str, object]:
    """Most frequent non-null value per column (ties: lowest value), typed.

    One count over all columns by key (``top_values``); only the winning texts reach the driver.
    """
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {r["column_name"]: r["value"] for r in top_values(df, cols, 1, keep).collect()}
    # Render back in the column's own type.
    typed = {}
    for c, v in out.items():
        dt = types[c]
        typed[c] = v if isinstance(dt, T.StringType) else (v, dt)
    return typed


def handle_missing(
    df: DataFrame,
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
) -> tuple[DataFrame, list[Action]]:
    out, actions, _ = _handle_missing(df, numeric_strategy, categorical_strategy)
    return out, actions


def _handle_missing(df: DataFrame, numeric_strategy: str, categorical_strategy: str):
    """Fill or drop nulls column by column, in column order.

    With a ``drop`` strategy each column's null count and fill value are taken on the
    rows that survive the drops of earlier columns; that is one aggregate with
    per-column conditions, not a loop of jobs.
    """
    fields = df.schema.fields
    num = {f.name for f in fields if is_numeric(f.dataType)}

    def strategy(c: str) -> str:
        return numeric_strategy if c in num else categorical_strategy

    # keep[c]: every earlier drop-strategy column is non-null.
    keep: dict[str, Column] = {}
    acc: Column = F.lit(True)
    for f in fields:
        keep[f.name] = acc
        if strategy(f.name) == "drop":
            acc = acc & col(f.name).isNotNull()

    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = col(f.name)
        exprs.append(F.count_if(keep[f.name] & c.isNull()).alias(f"n{i}"))
        if f.name in num and numeric_strategy in ("mean", "median"):
            exprs.append(F.count(F.when(keep[f.name], c)).alias(f"m{i}"))
            if numeric_strategy == "mean":
                exprs.append(F.avg(F.when(keep[f.name], c.cast("double"))).alias(f"a{i}"))
    row = agg_row(df, exprs)
    nulls = {f.name: row[f"n{i}"] for i, f in enumerate(fields)}
    with_nulls = [f.name for f in fields if nulls[f.name] > 0]

    fill: dict[str, object] = {}
    if numeric_strategy == "mean":
        for i, f in enumerate(fields):
            if f.name in with_nulls and f.name in num:
                fill[f.name] = row[f"a{i}"]
    elif numeric_strategy == "median":
        targets = [f for f in fields if f.name in with_nulls and f.name in num]
        if targets:
            masked = df.select(*[F.when(keep[f.name], col(f.name)).alias(f.name) for f in targets])
            ranks = {f.name: list(median_ranks(row[f"m{fields.index(f)}"])) for f in targets}
            stats = order_statistics(masked, ranks)
            for f in targets:
                n = row[f"m{fields.index(f)}"]
                if n > 0:
                    lo, hi = median_ranks(n)
                    fill[f.name] = (stats[f.name][lo] + stats[f.name][hi]) / 2.0
    modes = {}
    if categorical_strategy == "mode":
        modes = _mode_values(df, [c for c in with_nulls if c not in num], keep)

    actions: list[Action] = []
    drop_cols: list[str] = []
    exprs_out: dict[str, Column] = {}
    for f in fields:
        c, n = f.name, nulls[f.name]
        if n == 0:
            continue
        s = strategy(c)
        if s == "drop":
            drop_cols.append(c)
            actions.append(Action("drop_null_rows", c, TEXT_DROPPED.format(n=n, c=c), n))
        elif c in num:
            if s in ("mean", "median"):
                v = fill.get(c)
                if v is None:
                    continue
                exprs_out[c] = F.coalesce(col(c).cast("double"), F.lit(float(v)))
                actions.append(Action(f"fill_null_{s}", c, TEXT_FILLED_NUMBER.format(n=n, c=c, s=s, v=v), n))
            elif s == "zero":
                exprs_out[c] = F.coalesce(col(c), F.lit(0).cast(f.dataType))
                actions.append(Action("fill_null_zero", c, TEXT_FILLED_NUMBER.format(n=n, c=c, s="zero", v=0.0), n))
        else:
            if s not in ("mode", "unknown"):
                continue
            is_text = isinstance(f.dataType, T.StringType)
            if s == "mode" and c in modes:
                m = modes[c]
                if is_text:
                    value, lit = m, F.lit(m)
                else:
                    nested = isinstance(m[1], (T.ArrayType, T.MapType, T.StructType))
                    value, lit = m[0], F.from_json(F.lit(m[0]), m[1]) if nested else F.lit(m[0]).cast(m[1])
            elif is_text:
                value, lit = UNKNOWN, F.lit(UNKNOWN)
            else:
                actions.append(Action("skipped", c, TEXT_SKIPPED.format(n=n, c=c, u=UNKNOWN, t=f.dataType.simpleString()), 0))
                continue
            exprs_out[c] = F.coalesce(col(c), lit)
            actions.append(Action(f"fill_null_{s}", c, TEXT_FILLED_VALUE.format(n=n, c=c, v=value), n))

    out = df
    if drop_cols:
        cond = None
        for c in drop_cols:
            e = col(c).isNotNull()
            cond = e if cond is None else cond & e
        out = out.where(cond)
    if exprs_out:
        out = out.select(*[exprs_out[c].alias(c) if c in exprs_out else col(c) for c in out.columns])
    return out, actions, row["rows"]


# ---------------------------------------------------------------- C12


def coerce_types(df: DataFrame) -> tuple[DataFrame, list[Action]]:
    """A string column whose non-null values are all numbers (and has at least one)
    becomes double."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df, []
    exprs = []
    for i, c in enumerate(strings):
        exprs += [F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).rlike(NUMBER_TEXT)).alias(f"ok{i}")]
    row = agg_row(df, exprs)
    cast = [c for i, c in enumerate(strings) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"ok{i}"]]
    if not cast:
        return df, []
    out = df.select(*[col(c).cast("double").alias(c) if c in cast else col(c) for c in df.columns])
    return out, [Action("type_coercion", c, TEXT_CAST.format(c=c), 0) for c in cast]


# ---------------------------------------------------------------- C14


def clean(
    df: DataFrame,
    drop_duplicates_: bool = True,
    normalize_columns_: bool = True,
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
    n_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """names -> duplicates -> missing values -> coercion; returns (cleaned, actions).

    ``n_rows``: the input's row count when the caller already knows it."""
    actions: list[Action] = []
    if normalize_columns_:
        df, a = normalize_columns(df)
        if a:
            actions.append(a)
    before = (n_rows if n_rows is not None else df.count()) if drop_duplicates_ else None
    if drop_duplicates_:
        # Written once to the checkpoint folder: the statistics passes below and the
        # caller's own use read it instead of repeating the distinct shuffle.
        df = materialize(_dedup(df), "deduplicated")
    # The missing-value aggregate also counts the deduplicated rows, so the
    # distinct shuffle is not run a second time just to count it.
    df, acts, after = _handle_missing(df, numeric_strategy, categorical_strategy)
    if drop_duplicates_ and before - after > 0:
        dropped = before - after
        actions.append(Action("drop_duplicates", None, TEXT_DEDUP.format(dropped=dropped), dropped))
    actions += acts
    df, acts = coerce_types(df)
    actions += acts
    return df, actions_frame(df.sparkSession, actions)
