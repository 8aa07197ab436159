"""Full analysis (R1) and resume from the store (R2).

load -> profile (raw table) -> clean -> EDA (cleaned table) -> query and chart
instructions -> digest and quality flags. Each step is a lazy DataFrame; actions run
only for the small statistics the next step needs. The cleaned table is
written to the checkpoint folder (``spark.checkpoint.dir``) before EDA, so its several passes read
it back instead of repeating deduplication and fills, and a lost executor does not
send the work back to the raw input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabprobe.operators import charts, clean as cleaning, digest as dg, eda, profile as prof, query
from tabprobe.sources import fingerprint, readers, store

# The analysed tool's default options.
DEFAULTS = {
    "drop_duplicates": True,
    "normalize_columns": True,
    "numeric_fill_strategy": "median",
    "categorical_fill_strategy": "mode",
    "correlation_method": "pearson",
    "outlier_method": "iqr",
    "outlier_threshold": 1.5,
}


@dataclass
class Analysis:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    query_results: list = field(default_factory=list)
    charts: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    stopped: str | None = None


def analyze(df: DataFrame, name: str = "table", query_instructions: list | None = None,
            chart_instructions: list | None = None, **options) -> Analysis:
    """R1 on a DataFrame."""
    opts = {**DEFAULTS, **options}
    out = Analysis()
    profile = prof.profile(df)
    n_rows = next(iter(profile.stats.values()))["n_rows"] if profile.stats else 0
    if n_rows == 0:  # D6
        out.tables.update(profile=profile)
        out.stopped = "no rows"
        return out
    cleaned, actions = cleaning.clean(df, opts["drop_duplicates"], opts["normalize_columns"],
                                      opts["numeric_fill_strategy"], opts["categorical_fill_strategy"], n_rows=n_rows)
    if dg.is_empty(cleaned):  # the gate tests the cleaned table
        out.tables.update(profile=profile, actions=actions)
        out.stopped = "no rows after cleaning"
        return out
    moments = eda.numeric_moments(cleaned)
    summary = eda.numeric_summary(cleaned, moments=moments)
    cat_unique, cat_top = eda.categorical_summary(cleaned)
    corr = eda.correlation(cleaned, method=opts["correlation_method"])
    outl = eda.outliers(cleaned, method=opts["outlier_method"], threshold=opts["outlier_threshold"], moments=moments)
    text = dg.digest(name, n_rows, len(df.columns), profile, outl, corr, actions)
    flags = dg.quality_flags(profile, df, n_rows=n_rows)
    out.tables.update(profile=profile, actions=actions, cleaned=cleaned, numeric_summary=summary,
                      categorical_unique=cat_unique, categorical_top=cat_top, correlation=corr,
                      outliers=outl, digest=text, quality_flags=flags)
    if query_instructions:
        out.query_results, out.warnings = query.run_batch(cleaned, query_instructions)
    if chart_instructions:
        out.charts, warnings = charts.chart_data(cleaned, chart_instructions)
        out.warnings = out.warnings + warnings
    return out


def analyze_path(spark: SparkSession, path: str, cache_root: str | None = None, stage: str = "eda", by_content: bool = False,
                 reader_options: dict | None = None, **options) -> Analysis:
    """R1 from a file or directory, with R2: when ``cache_root`` holds a complete
    entry for this input, stage and options (instructions and reader options too), all its parts are
    read back instead. The input is known by its listing (path, length, modification time), or with
    ``by_content`` by a fingerprint of its rows."""
    df = readers.load(spark, path, **(reader_options or {}))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if cache_root is None:
        return analyze(df, name=name, **options)
    fp = fingerprint.table_fingerprint(df).first()["fingerprint"] if by_content else fingerprint.file_fingerprint(spark, path)
    key = store.cache_key(fp, stage, {**DEFAULTS, **options, "reader_options": reader_options or {}})
    cached = store.load(spark, cache_root, key)
    if cached is not None:
        return _unpack(*cached)
    result = analyze(df, name=name, **options)
    if result.stopped is None:
        store.save(cache_root, key, *_pack(result))
    return result


def _pack(result: Analysis) -> tuple[dict[str, DataFrame], dict]:
    tables = {f"table:{n}": t for n, t in result.tables.items()}
    tables |= {f"query:{i}": q for i, q in enumerate(result.query_results) if q is not None}
    tables |= {f"chart:{n}": c for n, c in result.charts.items()}
    return tables, {"queries": len(result.query_results), "warnings": result.warnings}


def _unpack(tables: dict[str, DataFrame], notes: dict) -> Analysis:
    def part(kind):
        return {n.split(":", 1)[1]: t for n, t in tables.items() if n.startswith(f"{kind}:")}

    queries = part("query")
    return Analysis(tables=part("table"), query_results=[queries.get(str(i)) for i in range(notes["queries"])],
                    charts=part("chart"), warnings=notes["warnings"])
