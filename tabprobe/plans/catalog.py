"""The driver's query catalogue: every operator as a query over the given tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is DuckDB SQL
over the same tables that must give the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.functions.exprs import col
from tabprobe.functions.stats import column_stats
from tabprobe.operators import charts, clean as cleaning, digest as dg, eda, profile as prof, query
from tabprobe.plans import oracle as O
from tabprobe.session import checkpoint_dir
from tabprobe.sources import fingerprint, partials, readers, store
from tabprobe.sources.workbook import read_workbooks, write_workbooks


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def doc_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def masked_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")))


def masked_orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumns({"o_orderpriority": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")),
                          "o_orderstatus": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))})


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints (the shared folder of the cluster)."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/scratch-{name}-{uuid.uuid4().hex[:8]}"


PROFILE_COLS = ["name", "dtype", "null_count", "null_pct", "unique_count", "mean", "median", "std", "min", "max", "position"]

# ----------------------------------------------------------------------------- profile


def q_profile_lineitem(spark, sf):
    return prof.profile(table(spark, sf, "lineitem")).select(*PROFILE_COLS)


def q_profile_with_nulls(spark, sf):
    return prof.profile(doc_labels(spark, sf)).select(*PROFILE_COLS)


def q_profile_top_values(spark, sf):
    p = prof.profile(table(spark, sf, "orders"))
    return (p.where(F.col("top_values").isNotNull())
            .select(F.col("name").alias("column_name"), F.posexplode("top_values").alias("pos", "tv"))
            .select("column_name", (F.col("pos") + 1).cast("int").alias("rank"), F.col("tv.value").alias("value"),
                    F.col("tv.count").alias("count")))


def q_profile_memory(spark, sf):
    return prof.memory_estimate(table(spark, sf, "orders"))


def q_profile_quick(spark, sf):
    df = readers.load(spark, f"{sf.rstrip('/')}/part.parquet")
    return prof.quick_profile(df)


def q_cardinality(spark, sf):
    return prof.cardinality(table(spark, sf, "part"))


def q_column_split(spark, sf):
    return prof.column_split(table(spark, sf, "lineitem"))


# ----------------------------------------------------------------------------- cleaning

MESSY = [("c_custkey", "Customer Key"), ("c_name", " Name "), ("c_nationkey", "NATION-key"),
         ("c_acctbal", "Acct.Bal"), ("c_mktsegment", "name")]


def q_clean_names(spark, sf):
    c = table(spark, sf, "customer").select(*[col(a).alias(b) for a, b in MESSY])
    out, _ = cleaning.normalize_columns(c)
    return out


def q_clean_dedup(spark, sf):
    # Whole rows, every one of them twice.
    li = table(spark, sf, "lineitem")
    out, _ = cleaning.drop_duplicates(li.unionByName(li))
    return out


def q_clean_drop_nulls(spark, sf):
    out, _ = cleaning.handle_missing(masked_lineitem(spark, sf), numeric_strategy="drop")
    return out


def _fill(strategy):
    def q(spark, sf):
        out, _ = cleaning.handle_missing(masked_lineitem(spark, sf), numeric_strategy=strategy)
        return out.withColumn("l_discount", F.round("l_discount", 6))
    return q


def _fill_cat(strategy):
    def q(spark, sf):
        out, _ = cleaning.handle_missing(masked_orders(spark, sf), numeric_strategy="median", categorical_strategy=strategy)
        return out
    return q


def q_clean_coerce(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("string"))
    out, _ = cleaning.coerce_types(li)
    return out


def q_clean_actions(spark, sf):
    _, actions = cleaning.clean(masked_orders(spark, sf))
    return actions


PIPE_NAMES = [("l_orderkey", "Order Key"), ("l_linenumber", "Line#"), ("l_discount", "Discount"), ("qty", "Qty"),
              ("l_returnflag", "Flag")]


def pipeline_input(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("Order Key"), F.col("l_linenumber").alias("Line#"),
                     F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("Discount"),
                     F.col("l_quantity").cast("string").alias("Qty"), F.col("l_returnflag").alias("Flag"))


def q_clean_pipeline(spark, sf):
    out, _ = cleaning.clean(pipeline_input(spark, sf))
    return out.select("order_key", "line", F.round("discount", 6).alias("discount"), "qty", "flag")


# ----------------------------------------------------------------------------- EDA


def q_eda_numeric(spark, sf):
    return eda.numeric_summary(table(spark, sf, "lineitem"))


def q_eda_categorical(spark, sf):
    uniq, _ = eda.categorical_summary(table(spark, sf, "orders"))
    return uniq


def q_eda_categorical_top(spark, sf):
    _, top = eda.categorical_summary(table(spark, sf, "orders"))
    return top


def q_eda_pearson(spark, sf):
    return eda.correlation(table(spark, sf, "lineitem"))


def q_eda_spearman(spark, sf):
    return eda.correlation(table(spark, sf, "lineitem"), method="spearman")


def q_eda_spearman_nulls(spark, sf):
    # quality and toxic have nulls; toxic_or_0 has one hot value
    df = doc_labels(spark, sf).withColumn("toxic_or_0", F.coalesce("toxic", F.lit(0)))
    return eda.correlation(df, method="spearman")


def q_eda_pearson_pairwise(spark, sf):
    return eda.correlation(doc_labels(spark, sf), nulls="pairwise")


def q_eda_outliers_guards(spark, sf):
    # A constant column and one with fewer than four values: no bounds, count 0.
    c = table(spark, sf, "customer").select("c_custkey", F.lit(7).alias("same"), F.when(F.col("c_custkey") < 3, F.col("c_custkey")).alias("few"))
    return eda.outliers(c, method="zscore", threshold=1.5)


def q_profile_decimals(spark, sf):
    # 20 digits: more than a double holds
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.lit("12345678901234567890").cast("decimal(20,0)") + F.col("c_nationkey").cast("decimal(20,0)")).cast("decimal(21,0)").alias("big"))
    return prof.profile(c).select("name", "dtype", "null_count", "unique_count")


def q_eda_pearson_nulls(spark, sf):
    return eda.correlation(doc_labels(spark, sf))


def q_eda_outliers_iqr(spark, sf):
    return eda.outliers(table(spark, sf, "lineitem"))


def q_eda_outliers_zscore(spark, sf):
    return eda.outliers(table(spark, sf, "part"), method="zscore", threshold=1.5)


def q_eda_outlier_columns(spark, sf):
    return eda.outlier_columns(eda.outliers(table(spark, sf, "lineitem")))


# ----------------------------------------------------------------------------- query logic

FILTERS = ["l_quantity > 30", "l_returnflag = 'R'", ("l_discount", "<=", 0.05)]


def q_query_filter(spark, sf):
    return query.filter_rows(table(spark, sf, "lineitem"), FILTERS)


def _group(aggs, src="lineitem"):
    def q(spark, sf):
        df = table(spark, sf, "lineitem")
        if src == "masked":
            df = df.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_discount")))
        out, _ = query.aggregate(df, ["l_returnflag", "l_linestatus"], aggs)
        return out.select(*[F.round(c, 4).alias(c) if c.endswith(("_mean", "_sum")) and not c.startswith("l_linenumber")
                            else F.col(c) for c in out.columns])
    return q


def q_query_batch(spark, sf):
    o = table(spark, sf, "orders")
    instructions = [
        {"groupby_columns": ["o_orderstatus"], "aggregations": {"o_totalprice": "mean"}},
        {"filter_conditions": ["o_orderpriority = '1-URGENT'"], "groupby_columns": ["o_orderstatus"],
         "aggregations": {"o_totalprice": "count", "no_such_column": "sum"}},
        {"groupby_columns": ["no_such_group"], "aggregations": {"o_totalprice": "sum"}},
    ]
    results, _ = query.run_batch(o, instructions)
    parts = []
    for i, r in enumerate(results):
        if r is None:
            continue
        metric = [c for c in r.columns if c != "o_orderstatus"][0]
        parts.append(r.select(F.lit(i).alias("instruction"), F.col("o_orderstatus").alias("group_key"),
                              F.lit(metric).alias("metric"), F.round(F.col(metric).cast("double"), 4).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_query_project_nonnull(spark, sf):
    return query.drop_null_rows(query.project(doc_labels(spark, sf), ["doc_id", "quality", "toxic"]), ["quality", "toxic"])


# ----------------------------------------------------------------------------- charts


def q_chart_histogram(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


def q_chart_bar_mean(spark, sf):
    return charts.bar_mean(table(spark, sf, "part"), "p_brand", "p_retailprice")


def q_chart_bar_count(spark, sf):
    return charts.bar_count(table(spark, sf, "orders"), "o_custkey")


def q_chart_scatter(spark, sf):
    return charts.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", size=charts.SCATTER_CAP, keys=["l_orderkey", "l_linenumber"])


def q_export_sample(spark, sf):
    return charts.render_text(charts.export_sample(table(spark, sf, "orders"), size=10_000, keys=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def q_chart_series(spark, sf):
    sample = charts.export_sample(table(spark, sf, "orders"))
    return charts.chart_series(sample, {"type": "bar", "x": "o_orderstatus", "y": "o_totalprice"})


# ----------------------------------------------------------------------------- digest, flags


def q_strong_correlations(spark, sf):
    li = table(spark, sf, "lineitem")
    corr = eda.correlation(li)
    pos = li.sparkSession.createDataFrame([(c, i) for i, c in enumerate(li.columns)], "column_name string, position int")
    return dg.strong_correlations(corr, pos).select("col_a", "col_b", "r")


def q_digest(spark, sf):
    li = table(spark, sf, "lineitem")
    stats = column_stats(li, skew=True)  # shared by the profile and the outlier quartiles
    p = prof.profile(li, stats=stats, quartiles=True)  # medians and quartiles in the same passes
    outl = eda.outliers(li, moments=eda.numeric_moments(li, stats=stats, order_stats=p.order_stats))
    corr = eda.correlation(li)
    n_rows = next(iter(stats.values()))["n_rows"]
    return dg.digest("lineitem", n_rows, len(li.columns), p, outl, corr)


def q_quality_flags(spark, sf):
    df = doc_labels(spark, sf)
    p = prof.profile(df, medians=False, tops=False)
    return dg.quality_flags(p, df, n_rows=next(iter(p.stats.values()))["n_rows"])


# ----------------------------------------------------------------------------- sources, store


def _roundtrip(fmt):
    def q(spark, sf):
        src = table(spark, sf, "part")
        path = scratch_dir(spark, fmt) + f"/part.{fmt}"
        if fmt == "csv":
            src.write.option("header", True).csv(path)
        elif fmt == "json":
            src.write.json(path)
        elif fmt == "parquet":
            src.write.parquet(path)
        opts = {"multi_line": False, "columns": src.columns} if fmt == "json" else {}
        return readers.load(spark, path, **opts)
    return q


def q_workbook_directory(spark, sf):
    src = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").repartition(4, "p_partkey")
    d = scratch_dir(spark, "xlsx")
    write_workbooks(src, d)
    return read_workbooks(spark, d)


def q_shape(spark, sf):
    return readers.shape(table(spark, sf, "customer"))


def q_empty_gate(spark, sf):
    c = table(spark, sf, "customer")
    return readers.shape(c).select("rows", "cols", (F.col("rows") == 0).alias("empty"))


def q_profile_record(spark, sf):
    return store.profile_records(prof.profile(table(spark, sf, "customer")))


def q_profile_record_fields(spark, sf):
    """The JSON records read back field by field."""
    r = store.profile_records(prof.profile(table(spark, sf, "customer")))

    def field(n, kind):
        return F.get_json_object("record", f"$.{n}").cast(kind).alias(n)

    return r.select("name", field("dtype", "string"), field("null_count", "bigint"), field("null_pct", "double"), field("unique_count", "bigint"),
                    *[field(n, "double") for n in ("mean", "median", "std", "min", "max")])


def q_profile_record_tops(spark, sf):
    """The top values that the JSON records hold, read back."""
    r = store.profile_records(prof.profile(table(spark, sf, "orders")))
    tops = F.from_json(F.get_json_object("record", "$.top_values"), "array<struct<value:string,count:bigint>>")
    return (r.where(tops.isNotNull()).select(F.col("name").alias("column_name"), F.posexplode(tops).alias("pos", "tv"))
            .select("column_name", (F.col("pos") + 1).cast("int").alias("rank"), F.col("tv.value").alias("value"), F.col("tv.count").alias("count")))


def q_fingerprint(spark, sf):
    return fingerprint.table_fingerprint(table(spark, sf, "documents"))


def q_chart_data(spark, sf):
    """All charts of one instruction list, bad ones left out, as (title, label, value)."""
    got, _ = charts.chart_data(table(spark, sf, "part"), [
        {"type": "bar", "x": "p_brand", "y": "p_retailprice", "title": "price"}, {"type": "bar", "x": "p_brand", "title": "count"},
        {"type": "histogram", "x": "p_name", "title": "bad"}, {"type": "pie", "x": "p_brand"},
        {"type": "histogram", "x": "p_size", "title": "size"}])
    parts = [got[t].select(F.lit(t).alias("title"), F.col("label"), F.col("value").cast("double").alias("value")) for t in ("price", "count")]
    parts.append(got["size"].select(F.lit("size").alias("title"), F.col("bin").cast("string").alias("label"), F.col("count").cast("double").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_clean_all_null(spark, sf):
    # C11: a text column without values falls back to the constant, a number column stays null.
    c = table(spark, sf, "customer").withColumns({"note": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    out, _ = cleaning.handle_missing(c, numeric_strategy="median", categorical_strategy="mode")
    return out


def q_cleaning_line(spark, sf):
    _, actions = cleaning.clean(masked_orders(spark, sf))
    return dg.cleaning_line(actions).select("text")


def q_strong_correlations_pages(spark, sf):
    # order keys, quantities and prices of lineitem: price follows quantity
    li = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("l_double"), "l_extendedprice",
                                             (-F.col("l_quantity")).alias("l_minus"))
    pos = spark.createDataFrame([(c, i) for i, c in enumerate(li.columns)], "column_name string, position int")
    return dg.strong_correlations(eda.correlation(li), pos).select("col_a", "col_b", "r")


def q_outlier_columns_skewed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return eda.outlier_columns(eda.outliers(d))


def q_gate_after_clean(spark, sf):
    """D6 on a table that cleaning empties (every row has a null) and on one it does not."""
    c = table(spark, sf, "customer")
    emptied, _ = cleaning.handle_missing(c.withColumn("c_acctbal", F.lit(None).cast("double")), numeric_strategy="drop")
    return spark.createDataFrame([("customer", dg.is_empty(c)), ("emptied", dg.is_empty(emptied))], "name string, empty boolean")


def q_documents_csv(spark, sf):
    """Documents through quoted CSV: cells with line ends, quotes doubled."""
    path = scratch_dir(spark, "documents-csv") + "/documents"
    table(spark, sf, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.load(spark, path, fmt="csv").select("doc_id", "text", "lang", "source", "n_chars")


def q_documents_json(spark, sf):
    """Documents through JSON lines in a directory without extension."""
    path = scratch_dir(spark, "documents-json") + "/documents"
    table(spark, sf, "documents").write.json(path)
    return readers.load(spark, path, columns=["doc_id", "text", "lang", "source", "n_chars"])


def q_analyze_parts(spark, sf):
    """Profile, outliers, flags and digest lines of one analysis, as (part, name, value)."""
    from tabprobe.plans.analyze import analyze

    t = analyze(table(spark, sf, "part"), name="part").tables
    out = t["profile"].select(F.lit("unique").alias("part"), "name", F.col("unique_count").cast("string").alias("value"))
    out = out.unionByName(t["outliers"].select(F.lit("outliers").alias("part"), F.col("column_name").alias("name"), F.col("count").cast("string").alias("value")))
    return out.unionByName(t["digest"].where("line = 0").select(F.lit("digest").alias("part"), F.lit("part").alias("name"), F.col("text").alias("value")))


def q_cache_reload(spark, sf):
    from tabprobe.plans.analyze import analyze_path

    root = scratch_dir(spark, "cache")
    path = f"{sf.rstrip('/')}/orders.parquet"
    analyze_path(spark, path, cache_root=root)  # computes and stores
    again = analyze_path(spark, path, cache_root=root)  # read back from the store
    return again.tables["numeric_summary"]


def q_refresh_added(spark, sf):
    """Orders in two batches of files: statistics of the first, then of both, which scans only the second.
    The approximate distinct counts are compared with exact ones."""
    orders = table(spark, sf, "orders")
    path, root = scratch_dir(spark, "orders") + "/orders.parquet", scratch_dir(spark, "partials")
    orders.where("o_orderpriority < '3'").write.parquet(path)
    partials.refresh(spark, path, root)
    orders.where("o_orderpriority >= '3' or o_orderpriority is null").write.mode("append").parquet(path)
    both = partials.refresh(spark, path, root)
    exact = spark.createDataFrame(list(prof.distinct_counts(orders).items()), "name string, unique_count bigint")
    near = F.abs(F.col("approx_unique") - F.col("unique_count")) <= F.col("unique_count") * 0.05
    return both.join(F.broadcast(exact), "name", "left").select(
        "position", "name", "dtype", "n_rows", "null_count", "mean", "std", "min", "max", "unique_count", near.alias("approx_within_5pct"))


def q_fingerprint_files(spark, sf):
    """Content fingerprints of the documents as JSON lines: the same at splits of 1 MB as at Spark's own, and another
    after one more row."""
    path = scratch_dir(spark, "documents-json") + "/documents"
    docs = table(spark, sf, "documents")
    docs.write.json(path)
    whole = fingerprint.file_fingerprint(spark, path, content=True)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 20))
    try:
        split = fingerprint.file_fingerprint(spark, path, content=True)
    finally:
        spark.conf.set(key, before)
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(path)
    added = fingerprint.file_fingerprint(spark, path, content=True)
    return docs.agg(F.count("*").alias("rows")).select("rows", F.lit(whole == split).alias("same"), F.lit(added != whole).alias("changed"))


def q_analyze(spark, sf):
    from tabprobe.plans.analyze import analyze

    return analyze(table(spark, sf, "orders"), name="orders").tables["numeric_summary"]


def q_profile_events(spark, sf):
    return prof.profile(table(spark, sf, "events")).select(*PROFILE_COLS)


def q_profile_top_events(spark, sf):
    p = prof.profile(table(spark, sf, "events"))
    return (p.where(F.col("top_values").isNotNull())
            .select(F.col("name").alias("column_name"), F.posexplode("top_values").alias("pos", "tv"))
            .select("column_name", (F.col("pos") + 1).cast("int").alias("rank"), F.col("tv.value").alias("value"),
                    F.col("tv.count").alias("count")))


def q_eda_numeric_nulls(spark, sf):
    return eda.numeric_summary(doc_labels(spark, sf))


def q_eda_outliers_nulls(spark, sf):
    return eda.outliers(doc_labels(spark, sf))


def _doclabel_clean(strategy):
    def q(spark, sf):
        df = doc_labels(spark, sf).select("doc_id", "lang", "quality", "toxic")
        out, _ = cleaning.handle_missing(df, numeric_strategy=strategy)
        return out
    return q


def q_chart_histogram_int(spark, sf):
    return charts.histogram(table(spark, sf, "part"), "p_size")


QUERIES = {
    "profile_lineitem": q_profile_lineitem,
    "profile_with_nulls": q_profile_with_nulls,
    "profile_top_values": q_profile_top_values,
    "profile_memory": q_profile_memory,
    "profile_quick": q_profile_quick,
    "cardinality": q_cardinality,
    "column_split": q_column_split,
    "clean_names": q_clean_names,
    "clean_dedup": q_clean_dedup,
    "clean_drop_nulls": q_clean_drop_nulls,
    "clean_fill_mean": _fill("mean"),
    "clean_fill_median": _fill("median"),
    "clean_fill_zero": _fill("zero"),
    "clean_fill_mode": _fill_cat("mode"),
    "clean_fill_unknown": _fill_cat("unknown"),
    "clean_coerce": q_clean_coerce,
    "clean_actions": q_clean_actions,
    "clean_pipeline": q_clean_pipeline,
    "eda_numeric": q_eda_numeric,
    "eda_categorical": q_eda_categorical,
    "eda_categorical_top": q_eda_categorical_top,
    "eda_pearson": q_eda_pearson,
    "eda_pearson_nulls": q_eda_pearson_nulls,
    "eda_spearman": q_eda_spearman,
    "eda_spearman_nulls": q_eda_spearman_nulls,
    "eda_pearson_pairwise": q_eda_pearson_pairwise,
    "eda_outliers_guards": q_eda_outliers_guards,
    "eda_outlier_columns_skewed": q_outlier_columns_skewed,
    "profile_decimals": q_profile_decimals,
    "chart_data": q_chart_data,
    "clean_all_null": q_clean_all_null,
    "cleaning_line": q_cleaning_line,
    "strong_correlations_derived": q_strong_correlations_pages,
    "empty_gate_cleaned": q_gate_after_clean,
    "documents_csv": q_documents_csv,
    "documents_json": q_documents_json,
    "analyze_parts": q_analyze_parts,
    "eda_outliers_iqr": q_eda_outliers_iqr,
    "eda_outliers_zscore": q_eda_outliers_zscore,
    "eda_outlier_columns": q_eda_outlier_columns,
    "query_filter": q_query_filter,
    "query_group_mean": _group({"l_extendedprice": "mean", "l_quantity": "mean"}),
    "query_group_sum": _group({"l_quantity": "sum", "l_linenumber": "sum"}),
    "query_group_count": _group({"l_orderkey": "count"}),
    "query_group_minmax": _group({"l_extendedprice": "min", "l_discount": "max"}),
    "query_group_multi": _group({"l_discount": "sum", "l_quantity": "mean", "l_orderkey": "count", "l_tax": "max"}, "masked"),
    "query_batch": q_query_batch,
    "query_project_nonnull": q_query_project_nonnull,
    "chart_histogram": q_chart_histogram,
    "chart_bar_mean": q_chart_bar_mean,
    "chart_bar_count": q_chart_bar_count,
    "chart_scatter": q_chart_scatter,
    "chart_series": q_chart_series,
    "export_sample": q_export_sample,
    "strong_correlations": q_strong_correlations,
    "digest": q_digest,
    "quality_flags": q_quality_flags,
    "csv_roundtrip": _roundtrip("csv"),
    "json_roundtrip": _roundtrip("json"),
    "parquet_roundtrip": _roundtrip("parquet"),
    "workbook_directory": q_workbook_directory,
    "shape": q_shape,
    "empty_gate": q_empty_gate,
    "profile_record": q_profile_record,
    "profile_record_fields": q_profile_record_fields,
    "profile_record_tops": q_profile_record_tops,
    "fingerprint": q_fingerprint,
    "cache_reload": q_cache_reload,
    "analyze": q_analyze,
    "refresh_added": q_refresh_added,
    "fingerprint_files": q_fingerprint_files,
    "profile_events": q_profile_events,
    "profile_top_events": q_profile_top_events,
    "eda_numeric_nulls": q_eda_numeric_nulls,
    "eda_outliers_nulls": q_eda_outliers_nulls,
    "clean_nulls_median": _doclabel_clean("median"),
    "clean_nulls_drop": _doclabel_clean("drop"),
    "chart_histogram_int": q_chart_histogram_int,
}


def _q(sql: str) -> str:
    return " ".join(sql.split())


def _pairs_with_pos(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pos_a, {j} AS pos_b, "
                         f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS r FROM {tbl} t")
    return O.union(parts)


def _mode(tbl: str, c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {tbl} m WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v ASC LIMIT 1)")


def _fill_detail(c: str) -> str:
    q = "'"
    return f"'Filled ' || n || ' nulls in {q}{q}{c}{q}{q} with {q}{q}{q} || m || {q}{q}{q}{q}"


_P_LI = O.profile_sql("lineitem", O.LINEITEM_TYPES)
_P_PART = O.profile_sql("part", O.PART_TYPES)
_P_DL = O.profile_sql(O.DOCLABEL, O.DOCLABEL_TYPES)
_ML = O.MASKED_LINEITEM
_MO = O.MASKED_ORDERS
_ORD_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
_PIPE = ("(SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS d, "
         "l_quantity, l_returnflag FROM lineitem)")
_GROUP = "FROM lineitem GROUP BY l_returnflag, l_linestatus"
_IQR_LI = O.outliers_iqr_sql("lineitem", O.LINEITEM_NUM)
_STRONG = (f"SELECT col_a, col_b, r, pos_a, pos_b FROM ({_pairs_with_pos('lineitem', O.LINEITEM_NUM)}) "
           f"WHERE col_a < col_b AND abs(r) > 0.3 ORDER BY pos_a, pos_b")
_NUMTYPES = "('tinyint','smallint','int','bigint','float','double')"
_COLTEXT = ("name || '(' || dtype || ',' || unique_count || 'u' || CASE WHEN null_count > 0 THEN ',' || null_count || 'n' "
            "ELSE '' END || ')'")

ORACLE = {
    "profile_lineitem": _P_LI,
    "profile_with_nulls": _P_DL,
    "profile_top_values": O.top_values_sql("orders", _ORD_CAT),
    "profile_memory": ("SELECT CAST(count(*) * 8 + count(*) * 8 + coalesce(sum(strlen(o_orderstatus)), 0) + count(*) * 8 "
                       "+ count(*) * 8 + coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) AS estimated_bytes FROM orders"),
    "profile_quick": f"SELECT name, dtype, null_count, unique_count, mean, min, max FROM ({_P_PART})",
    "cardinality": f"SELECT name, unique_count FROM ({_P_PART})",
    "column_split": (f"SELECT count(*) FILTER (WHERE dtype IN {_NUMTYPES}) AS n_numeric, "
                     f"count(*) FILTER (WHERE dtype NOT IN {_NUMTYPES}) AS n_categorical FROM ({_P_LI})"),
    "clean_names": ("SELECT c_custkey AS customer_key, c_name AS name, c_nationkey AS nation_key, c_acctbal AS acct_bal, "
                    "c_mktsegment AS name_1 FROM customer"),
    "clean_dedup": "SELECT DISTINCT * FROM lineitem",
    "clean_drop_nulls": f"SELECT * FROM {_ML} WHERE l_discount IS NOT NULL",
    "clean_fill_mean": (f"SELECT * REPLACE (round(coalesce(l_discount, (SELECT avg(l_discount) FROM {_ML})), 6) AS l_discount) FROM {_ML}"),
    "clean_fill_median": (f"SELECT * REPLACE (round(coalesce(l_discount, (SELECT median(l_discount) FROM {_ML})), 6) AS l_discount) FROM {_ML}"),
    "clean_fill_zero": f"SELECT * REPLACE (round(coalesce(l_discount, 0.0), 6) AS l_discount) FROM {_ML}",
    "clean_fill_mode": (f"SELECT * REPLACE (coalesce(o_orderpriority, {_mode(_MO, 'o_orderpriority')}) AS o_orderpriority, "
                        f"coalesce(o_orderstatus, {_mode(_MO, 'o_orderstatus')}) AS o_orderstatus) FROM {_MO}"),
    "clean_fill_unknown": ("SELECT * REPLACE (coalesce(o_orderpriority, 'Unknown') AS o_orderpriority, "
                           f"coalesce(o_orderstatus, 'Unknown') AS o_orderstatus) FROM {_MO}"),
    "clean_coerce": "SELECT * FROM lineitem",
    "clean_actions": (
        f"SELECT 0 AS step, 'fill_null_mode' AS action, 'o_orderstatus' AS \"column\", {_fill_detail('o_orderstatus')} "
        f"AS detail, n AS rows_affected "
        f"FROM (SELECT count(*) - count(o_orderstatus) AS n, {_mode(_MO, 'o_orderstatus')} AS m FROM {_MO}) "
        f"UNION ALL SELECT 1, 'fill_null_mode', 'o_orderpriority', {_fill_detail('o_orderpriority')}, n "
        f"FROM (SELECT count(*) - count(o_orderpriority) AS n, {_mode(_MO, 'o_orderpriority')} AS m FROM {_MO})"),
    "clean_pipeline": (f"SELECT l_orderkey AS order_key, l_linenumber AS line, round(coalesce(d, (SELECT median(d) FROM {_PIPE})), 6) "
                       f"AS discount, l_quantity AS qty, l_returnflag AS flag FROM {_PIPE}"),
    "eda_numeric": O.numeric_summary_sql("lineitem", O.LINEITEM_NUM),
    "eda_categorical": O.union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM orders" for c in _ORD_CAT]),
    "eda_categorical_top": O.top_values_sql("orders", _ORD_CAT),
    "eda_pearson": O.pearson_sql("lineitem", O.LINEITEM_NUM),
    "eda_pearson_nulls": O.pearson_sql(O.DOCLABEL, ["doc_id", "n_chars", "quality", "toxic"]),
    "eda_spearman": O.pearson_sql(O.avg_rank_table("lineitem", O.LINEITEM_NUM), O.LINEITEM_NUM),
    "eda_outliers_iqr": _IQR_LI,
    "eda_outliers_zscore": O.outliers_z_sql("part", ["p_partkey", "p_size", "p_retailprice"]),
    "eda_outlier_columns": f"SELECT count(*) FILTER (WHERE count > 0) AS outlier_columns FROM ({_IQR_LI})",
    "query_filter": "SELECT * FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_discount <= 0.05",
    "query_group_mean": (f"SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, "
                         f"round(avg(l_quantity), 4) AS l_quantity_mean {_GROUP}"),
    "query_group_sum": (f"SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 4) AS l_quantity_sum, "
                        f"CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS l_linenumber_sum {_GROUP}"),
    "query_group_count": f"SELECT l_returnflag, l_linestatus, count(*) AS l_orderkey_count {_GROUP}",
    "query_group_minmax": (f"SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS l_extendedprice_min, "
                           f"max(l_discount) AS l_discount_max {_GROUP}"),
    "query_group_multi": (
        "SELECT l_returnflag, l_linestatus, round(coalesce(sum(d), 0), 4) AS l_discount_sum, "
        "round(avg(l_quantity), 4) AS l_quantity_mean, count(*) AS l_orderkey_count, max(l_tax) AS l_tax_max "
        "FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem) "
        "GROUP BY l_returnflag, l_linestatus"),
    "query_batch": ("SELECT 0 AS instruction, o_orderstatus AS group_key, 'o_totalprice_mean' AS metric, "
                    "round(avg(o_totalprice), 4) AS value FROM orders GROUP BY o_orderstatus UNION ALL "
                    "SELECT 1, o_orderstatus, 'o_totalprice_count', round(CAST(count(*) AS DOUBLE), 4) FROM orders "
                    "WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus"),
    "query_project_nonnull": f"SELECT doc_id, quality, toxic FROM {O.DOCLABEL} WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "chart_histogram": (
        "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), "
        "c AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS count "
        "FROM lineitem, b GROUP BY 1) "
        "SELECT r.bin, round(lo + r.bin * ((hi - lo) / 30), 4) AS lower, round(lo + (r.bin + 1) * ((hi - lo) / 30), 4) AS upper, "
        "coalesce(c.count, 0) AS count FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) r CROSS JOIN b "
        "LEFT JOIN c ON r.bin = c.bin"),
    "chart_bar_mean": ("SELECT p_brand AS label, round(avg(p_retailprice), 4) AS value FROM part WHERE p_brand IS NOT NULL "
                       "GROUP BY p_brand HAVING avg(p_retailprice) IS NOT NULL ORDER BY avg(p_retailprice) DESC, label ASC LIMIT 15"),
    "chart_bar_count": ("SELECT o_custkey AS label, count(*) AS value FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey "
                        "ORDER BY value DESC, label ASC LIMIT 15"),
    "chart_series": "SELECT o_orderstatus, o_totalprice FROM orders",
    "strong_correlations": f"SELECT col_a, col_b, r FROM ({_STRONG})",
    "digest": (
        f"SELECT 0 AS line, 'Dataset: lineitem (' || count(*) || '×11)' AS text FROM lineitem UNION ALL "
        f"SELECT 1, 'Numeric: ' || string_agg({_COLTEXT} || CASE WHEN mean IS NOT NULL THEN '[μ=' || printf('%.1f', round(mean, 1)) "
        f"|| ']' ELSE '' END, ', ' ORDER BY position) FROM ({_P_LI}) WHERE dtype IN {_NUMTYPES} UNION ALL "
        f"SELECT 2, 'Categorical: ' || string_agg({_COLTEXT}, ', ' ORDER BY position) FROM ({_P_LI}) WHERE dtype NOT IN {_NUMTYPES} "
        f"UNION ALL SELECT 3, 'Outliers: ' || string_agg(column_name || '(' || count || ',' || printf('%.2f', pct) || '%)', ', ' "
        f"ORDER BY position) FROM ({_IQR_LI}) UNION ALL "
        f"SELECT 4, 'Correlations: ' || string_agg(col_a || '↔' || col_b || '(' || printf('%.2f', r) || ')', ', ' ORDER BY pos_a, pos_b) "
        f"FROM ({_STRONG}) HAVING count(*) > 0"),
    "quality_flags": (
        f"SELECT name AS column_name, 'high_nulls' AS flag, printf('%.2f%% null', null_pct) AS detail FROM ({_P_DL}) "
        f"WHERE null_pct >= 50.0 UNION ALL SELECT name, 'constant', 'one distinct value' FROM ({_P_DL}) WHERE unique_count = 1 "
        f"UNION ALL SELECT name, 'key_like', 'every value distinct' FROM ({_P_DL}) "
        f"WHERE unique_count = (SELECT count(*) FROM {O.DOCLABEL}) AND (SELECT count(*) FROM {O.DOCLABEL}) > 1"),
    "csv_roundtrip": "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "json_roundtrip": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "parquet_roundtrip": "SELECT * FROM part",
    "workbook_directory": "SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "shape": "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS cols FROM customer",
    "empty_gate": "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS cols, count(*) = 0 AS empty FROM customer",
    "cache_reload": O.numeric_summary_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "analyze": O.numeric_summary_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
}
_EVENTS_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
                 "value": "double", "props": "string"}
_DL_NUM = ["doc_id", "n_chars", "quality", "toxic"]
_DL4 = f"(SELECT doc_id, lang, quality, toxic FROM {O.DOCLABEL})"
ORACLE.update({
    "profile_events": O.profile_sql("events", _EVENTS_TYPES),
    "profile_top_events": O.top_values_sql("events", ["ts", "event_type", "props"]),
    "eda_numeric_nulls": O.numeric_summary_sql(O.DOCLABEL, _DL_NUM),
    "eda_outliers_nulls": O.outliers_iqr_sql(O.DOCLABEL, _DL_NUM),
    "clean_nulls_median": (f"SELECT doc_id, lang, coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM {_DL4})) AS quality, "
                           f"coalesce(CAST(toxic AS DOUBLE), (SELECT median(toxic) FROM {_DL4})) AS toxic FROM {_DL4}"),
    "clean_nulls_drop": f"SELECT * FROM {_DL4} WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "chart_histogram_int": (
        "WITH b AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part), "
        "c AS (SELECT CAST(least(floor((p_size - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS count "
        "FROM part, b GROUP BY 1) "
        "SELECT r.bin, round(lo + r.bin * ((hi - lo) / 30), 4) AS lower, round(lo + (r.bin + 1) * ((hi - lo) / 30), 4) AS upper, "
        "coalesce(c.count, 0) AS count FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) r CROSS JOIN b "
        "LEFT JOIN c ON r.bin = c.bin"),
})
_RANKED_DL = ("(SELECT quality, toxic, " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("doc_id", "n_chars", "toxic_or_0"))
    + f" FROM (SELECT *, coalesce(toxic, 0) AS toxic_or_0 FROM {O.DOCLABEL}))")
_DERIVED = ("(SELECT l_quantity, l_quantity * 2 + l_linenumber AS l_double, l_extendedprice, -l_quantity AS l_minus FROM lineitem)")
_ROWTEXT = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "text", "lang", "source", "n_chars"))


def _pairwise(cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) FROM {O.DOCLABEL} t) AS r")
    return O.union(parts)


ORACLE.update({
    "refresh_added": f"SELECT * EXCLUDE (null_pct, median), (SELECT count(*) FROM orders) AS n_rows, true AS approx_within_5pct FROM ({O.profile_sql('orders', O.ORDERS_TYPES)})",
    "profile_record_tops": O.top_values_sql("orders", _ORD_CAT),
    "fingerprint_files": "SELECT count(*) AS rows, true AS same, true AS changed FROM documents",
    "profile_record_fields": f"SELECT * EXCLUDE (position) FROM ({O.profile_sql('customer', O.CUSTOMER_TYPES)})",
    "eda_spearman_nulls": O.pearson_sql(_RANKED_DL, ["doc_id", "n_chars", "quality", "toxic", "toxic_or_0"]),
    "eda_pearson_pairwise": _pairwise(_DL_NUM),
    "eda_outliers_guards": (
        "SELECT 'c_custkey' AS column_name, 0 AS position, count(*) FILTER (abs((c_custkey - mu) / s) > 1.5) AS count, "
        "round(count(*) FILTER (abs((c_custkey - mu) / s) > 1.5) / count(*) * 100.0::DOUBLE, 2) AS pct, "
        "round(max(mu) - 1.5 * max(s), 4) AS lower, round(max(mu) + 1.5 * max(s), 4) AS upper "
        "FROM customer, (SELECT avg(c_custkey) AS mu, stddev_samp(c_custkey) AS s FROM customer) UNION ALL "
        "SELECT 'same', 1, 0, 0.0, NULL, NULL UNION ALL SELECT 'few', 2, 0, 0.0, NULL, NULL"),
    "eda_outlier_columns_skewed": f"SELECT count(*) FILTER (WHERE count > 0) AS outlier_columns FROM ({O.outliers_iqr_sql('documents', ['doc_id', 'n_chars'])})",
    "profile_decimals": ("SELECT 'c_custkey' AS name, 'bigint' AS dtype, 0 AS null_count, count(DISTINCT c_custkey) AS unique_count FROM customer "
                         "UNION ALL SELECT 'big', 'decimal(21,0)', 0, count(DISTINCT c_nationkey) FROM customer"),
    "chart_data": (
        "SELECT 'price' AS title, label, value FROM (SELECT p_brand AS label, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1 "
        "ORDER BY avg(p_retailprice) DESC, label LIMIT 15) UNION ALL SELECT 'count', label, value FROM (SELECT p_brand AS label, "
        "CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1 ORDER BY value DESC, label LIMIT 15) UNION ALL "
        "SELECT 'size', CAST(r.bin AS VARCHAR), CAST(coalesce(c.n, 0) AS DOUBLE) FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) r "
        "LEFT JOIN (SELECT CAST(least(floor((p_size - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM part, "
        "(SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part) GROUP BY 1) c ON r.bin = c.bin"),
    "clean_all_null": "SELECT *, 'Unknown' AS note, NULL::DOUBLE AS score FROM customer",
    "cleaning_line": "SELECT 'fill_null_mode(o_orderstatus), fill_null_mode(o_orderpriority)' AS text",
    "strong_correlations_derived": (f"SELECT col_a, col_b, r FROM ({_pairs_with_pos(_DERIVED, ['l_quantity', 'l_double', 'l_extendedprice', 'l_minus'])}) "
                                    f"WHERE col_a < col_b AND abs(r) > 0.3"),
    "empty_gate_cleaned": "SELECT 'customer' AS name, count(*) = 0 AS empty FROM customer UNION ALL SELECT 'emptied', true",
    "documents_csv": "SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang, source, CAST(n_chars AS INTEGER) AS n_chars FROM documents",
    "documents_json": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "analyze_parts": (
        f"SELECT 'unique' AS part, name, CAST(unique_count AS VARCHAR) AS value FROM ({_P_PART}) UNION ALL "
        f"SELECT 'outliers', column_name, CAST(count AS VARCHAR) FROM ({O.outliers_iqr_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])}) "
        f"UNION ALL SELECT 'digest', 'part', 'Dataset: part (' || count(*) || '×6)' FROM part"),
    "chart_scatter": ("SELECT l_quantity AS x, l_extendedprice AS y FROM (SELECT * FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL "
                      "ORDER BY md5(l_orderkey || '|' || l_linenumber), CAST(l_quantity AS VARCHAR), CAST(l_extendedprice AS VARCHAR) LIMIT 5000)"),
    "export_sample": ("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders "
                      "ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 10000"),
    "fingerprint": ("SELECT count(*) AS rows, sha256('struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>|' || count(*) || '|' || "
                    f"CAST(sum(CAST(CAST('0x' || substr(md5({_ROWTEXT}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM documents"),
})
ORACLE = {k: _q(v) for k, v in ORACLE.items()}
