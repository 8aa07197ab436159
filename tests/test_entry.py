import importlib.util
import os

import pytest


def _entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry()
    rows = mod.entry(spark).collect()
    assert len(rows) == 11
    assert set(mod.oracle_sql()) <= set(mod.queries())


@pytest.mark.parametrize("name", ["query_group_mean", "chart_bar_mean", "eda_outliers_zscore", "clean_fill_median", "chart_scatter",
                                  "eda_spearman_nulls", "eda_pearson_pairwise", "fingerprint", "documents_csv", "chart_data"])
def test_queries_match_oracle(spark, name):
    import duckdb

    from tools.oracle_check import TABLES, rows_of

    mod = _entry()
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = mod.queries()[name](spark, sf)
    res = con.execute(mod.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())
