import pytest

from tabprobe.functions.conditions import parse_condition
from tabprobe.operators import query as Q


def test_parse():
    assert parse_condition("age > 30") == ("age", ">", 30)
    assert parse_condition("name = 'Bob'") == ("name", "=", "Bob")
    assert parse_condition("`Start Date` is not null") == ("Start Date", "is not null", None)
    assert parse_condition("dept in ('Eng', 'HR')") == ("dept", "in", ["Eng", "HR"])
    with pytest.raises(ValueError):
        parse_condition("reflect('java.lang.Runtime','getRuntime')")


def test_filter(boats_df):
    assert Q.filter_rows(boats_df, ["length > 10", ("rig", "=", "sloop")]).count() == 2
    with pytest.raises(ValueError):
        Q.filter_rows(boats_df, ["nope > 1"])
    assert Q.filter_rows(boats_df, ["rig = sloop and length > 10"]).count() == 2
    assert Q.filter_rows(boats_df, ["boat = 'Salt and Sand' AND length in (1, 2)"]).count() == 0
    with pytest.raises(ValueError):
        Q.filter_rows(boats_df, ["boat = Old Tern"])
    assert parse_condition("x = 1_000") == ("x", "=", "1_000")


def test_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    out, warnings = Q.aggregate(df, ["k"], {"v": "mean", "zz": "sum"})
    assert out.columns == ["k", "v_mean"] and warnings
    rows = {r["k"]: r for r in Q.aggregate(df, ["k"], {"v": "sum"})[0].collect()}
    assert rows["b"]["v_sum"] == 0  # an all-null group sums to 0
    cnt = {r["k"]: r["v_count"] for r in Q.aggregate(df, ["k"], {"v": "count"})[0].collect()}
    assert cnt == {"a": 2, "b": 1}  # row count, nulls included
    mm = Q.aggregate(df, ["k"], {"v": "max"})[0]
    assert mm.columns == ["k", "v_max"]
    assert Q.aggregate(df, ["missing"], {"v": "sum"})[0] is None


def test_batch_and_nonnull(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1)], "k string, v double, w int")
    res, warnings = Q.run_batch(df, [{"groupby_columns": ["k"], "aggregations": {"v": "sum"}},
                                     {"groupby_columns": ["zz"], "aggregations": {"v": "sum"}},
                                     {"filter_conditions": ["no_such > 1"]}, {"filter_conditions": ["w is not null"]}])
    assert res[0] is not None and res[1] is None and res[2] is None and res[3].count() == 1 and len(warnings) == 2
    assert Q.drop_null_rows(Q.project(df, ["k", "w"]), ["w"]).count() == 1
