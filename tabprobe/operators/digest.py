"""The short text digest, data-quality flags and the empty-table gate.

All inputs are the small result tables (one row per column or per action), so the
string assembly aggregates at most a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.exprs import col
from tabprobe.operators.clean import NUMBER_TEXT

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# The digest's line formats, as the analysed tool writes them
# (the outlier item format is our own).
LINE_DATASET = "Dataset: {name} ({rows}×{cols})"
LINE_NUMERIC = "Numeric: "
LINE_CATEGORICAL = "Categorical: "
LINE_OUTLIERS = "Outliers: "
LINE_CORRELATIONS = "Correlations: "
LINE_CLEANING = "Cleaning: "
PAIR_ARROW = "↔"
MEAN_MARK = "[μ="


def is_numeric_type(dtype: Column) -> Column:
    return dtype.isin(*NUMERIC_TYPES) | dtype.startswith("decimal")


def _join(df: DataFrame, order: list[Column], text: Column, sep: str = ", ") -> DataFrame:
    """One row ``text`` joining ``text`` of every row in ``order``."""
    items = df.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("t")).alias("s"))
    return items.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda e: e["t"]), sep).alias("text"),
                     F.count(F.lit(1)).alias("n"))


def column_lines(prof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The 'Numeric:' and 'Categorical:' lines from the profile table."""
    base = F.concat(F.col("name"), F.lit("("), F.col("dtype"), F.lit(","), F.col("unique_count").cast("string"), F.lit("u"),
                    F.when(F.col("null_count") > 0, F.concat(F.lit(","), F.col("null_count").cast("string"), F.lit("n")))
                    .otherwise(F.lit("")), F.lit(")"))
    num_text = F.concat(base, F.when(F.col("mean").isNotNull(),
                                     F.concat(F.lit(MEAN_MARK), F.format_string("%.1f", F.round(F.col("mean"), 1)), F.lit("]")))
                        .otherwise(F.lit("")))
    numeric = _join(prof.where(is_numeric_type(F.col("dtype"))), [F.col("position")], num_text)
    other = _join(prof.where(~is_numeric_type(F.col("dtype"))), [F.col("position")], base)
    return numeric, other


def outlier_line(outl: DataFrame) -> DataFrame:
    """Every column with its outlier count and percentage."""
    text = F.concat(F.col("column_name"), F.lit("("), F.col("count").cast("string"), F.lit(","),
                    F.format_string("%.2f", F.col("pct")), F.lit("%)"))
    return _join(outl, [F.col("position")], text)


def strong_correlations(corr: DataFrame, positions: DataFrame, threshold: float = 0.3, top: int | None = None,
                        order: str = "column") -> DataFrame:
    """D3: every pair with col_a < col_b (by name) and |r| > threshold; the first ``top`` if asked for.

    ``order="column"`` keeps matrix order (row column, then column position);
    ``"strength"`` takes the strongest first.
    """
    p = positions.select(F.col("column_name").alias("n"), F.col("position").alias("pos"))
    pairs = (corr.where((F.col("col_a") < F.col("col_b")) & (F.abs(F.col("r")) > F.lit(threshold)))
             .join(p.withColumnRenamed("n", "col_a").withColumnRenamed("pos", "pos_a"), "col_a")
             .join(p.withColumnRenamed("n", "col_b").withColumnRenamed("pos", "pos_b"), "col_b"))
    if order == "strength":
        ordered = pairs.orderBy(F.desc(F.abs(F.col("r"))), "pos_a", "pos_b")
    else:
        ordered = pairs.orderBy("pos_a", "pos_b")
    ordered = ordered if top is None else ordered.limit(top)
    return ordered.select("col_a", "col_b", "r", "pos_a", "pos_b")


def correlation_line(strong: DataFrame, order: str = "column") -> DataFrame:
    text = F.concat(F.col("col_a"), F.lit(PAIR_ARROW), F.col("col_b"), F.lit("("), F.format_string("%.2f", F.col("r")), F.lit(")"))
    keys = [F.col("pos_a"), F.col("pos_b")] if order == "column" else [-F.abs(F.col("r")), F.col("pos_a"), F.col("pos_b")]
    return _join(strong, keys, text)


def cleaning_line(actions: DataFrame, top: int | None = None) -> DataFrame:
    """The cleaning actions as action(column); the first ``top`` if asked for."""
    first = actions if top is None else actions.where(F.col("step") < top)
    text = F.concat(F.col("action"), F.lit("("), F.coalesce(F.col("column"), F.lit("None")), F.lit(")"))
    return _join(first, [F.col("step")], text)


def digest(name: str, n_rows: int, n_cols: int, prof: DataFrame, outl: DataFrame | None = None,
           corr: DataFrame | None = None, actions: DataFrame | None = None,
           corr_order: str = "column") -> DataFrame:
    """(line, text), one row per digest line, in order."""
    spark = prof.sparkSession
    lines = [spark.createDataFrame([(0, LINE_DATASET.format(name=name, rows=n_rows, cols=n_cols), 1)], "line int, text string, n long")]
    numeric, other = column_lines(prof)
    lines.append(numeric.select(F.lit(1).alias("line"), F.concat(F.lit(LINE_NUMERIC), "text").alias("text"), "n"))
    lines.append(other.select(F.lit(2).alias("line"), F.concat(F.lit(LINE_CATEGORICAL), "text").alias("text"), "n"))
    if outl is not None:
        lines.append(outlier_line(outl).select(F.lit(3).alias("line"), F.concat(F.lit(LINE_OUTLIERS), "text").alias("text"), "n"))
    if corr is not None:
        pos = prof.select(F.col("name").alias("column_name"), "position")
        strong = strong_correlations(corr, pos, order=corr_order)
        lines.append(correlation_line(strong, corr_order).select(F.lit(4).alias("line"),
                                                                 F.concat(F.lit(LINE_CORRELATIONS), "text").alias("text"), "n"))
    if actions is not None:
        lines.append(cleaning_line(actions).select(F.lit(5).alias("line"), F.concat(F.lit(LINE_CLEANING), "text").alias("text"), "n"))
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out.where(F.col("n") > 0).select("line", "text")


def quality_flags(prof: DataFrame, df: DataFrame | None = None, null_pct_threshold: float = 50.0,
                  n_rows: int | None = None) -> DataFrame:
    """Rule-based flags from the profile table.

    high_nulls: null_pct >= threshold; constant: one value (null counts as one);
    key_like: every row holds a different value (more than one row);
    numeric_text: a string column whose non-null values are all numbers (needs ``df``).
    """
    flags = [
        prof.where(F.col("null_pct") >= F.lit(null_pct_threshold)).select(
            F.col("name").alias("column_name"), F.lit("high_nulls").alias("flag"),
            F.format_string("%.2f%% null", F.col("null_pct")).alias("detail")),
        prof.where(F.col("unique_count") == 1).select(
            F.col("name").alias("column_name"), F.lit("constant").alias("flag"), F.lit("one distinct value").alias("detail")),
    ]
    if df is not None:
        rows = n_rows if n_rows is not None else df.count()
        flags.append(prof.where((F.col("unique_count") == F.lit(rows)) & F.lit(rows > 1)).select(
            F.col("name").alias("column_name"), F.lit("key_like").alias("flag"), F.lit("every value distinct").alias("detail")))
        strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if strings:
            exprs = []
            for i, c in enumerate(strings):
                exprs += [F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).rlike(NUMBER_TEXT)).alias(f"ok{i}")]
            from tabprobe.functions.stats import agg_row
            row = agg_row(df, exprs)
            numeric_text = [c for i, c in enumerate(strings) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"ok{i}"]]
            if numeric_text:
                flags.append(df.sparkSession.createDataFrame(
                    [(c, "numeric_text", "text values that are all numbers") for c in numeric_text],
                    "column_name string, flag string, detail string"))
    out = flags[0]
    for f in flags[1:]:
        out = out.unionByName(f)
    return out


def is_empty(df: DataFrame) -> bool:
    """Stop when there are no rows (reads at most one row)."""
    return df.isEmpty()
