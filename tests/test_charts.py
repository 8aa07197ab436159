import numpy as np
import pytest

from tabprobe.operators import charts as V


def test_histogram_vs_numpy(spark):
    x = np.random.default_rng(3).normal(size=500).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    got = [r["count"] for r in V.histogram(df, "a").orderBy("bin").collect()]
    expect, _ = np.histogram(x, bins=30)
    assert sum(got) == 500 and len(got) == 30
    assert sum(abs(a - b) for a, b in zip(got, expect)) <= 2  # float edges may move a boundary value


def test_histogram_skips_infinities_and_refuses_text(spark):
    df = spark.createDataFrame([(float(v), "t") for v in [0, 1, 2, 30, float("inf"), float("-inf"), float("nan")]], "a double, t string")
    rows = V.histogram(df, "a").orderBy("bin").collect()
    assert sum(r["count"] for r in rows) == 4 and (rows[0]["lower"], rows[-1]["upper"]) == (0.0, 30.0)
    with pytest.raises(ValueError):
        V.histogram(df, "t")


def test_bars(boats_df):
    means = [(r["label"], r["value"]) for r in V.bar_mean(boats_df, "rig", "sail").collect()]
    assert means == [("ketch", 720.25), ("sloop", round((410.5 + 980.0 + 505.0) / 3, 4)), ("yawl", 455.0)]
    assert [(r["label"], r["value"]) for r in V.bar_count(boats_df, "rig").collect()] == [("sloop", 3), ("ketch", 2), ("yawl", 1)]
    assert V.scatter(boats_df, "length", "sail").count() == 5


def test_bad_charts_leave_the_others(boats_df):
    got, warnings = V.chart_data(boats_df, [
        {"type": "histogram", "x": "boat", "title": "text"}, {"type": "bar", "x": "rig", "y": "sail", "title": "bar"}, {"type": "pie", "x": "rig"},
        {"type": "scatter", "x": "length", "y": "nope"}, None, {"type": "histogram", "x": "length", "title": "lengths"}])
    assert set(got) == {"bar", "lengths"} and len(warnings) == 4


def test_stated_samples_only(spark):
    big = spark.range(6000).selectExpr("id", "id * 2 AS y", "cast(id % 7 AS string) AS z")
    assert V.export_sample(big).count() == 6000 and V.scatter(big, "id", "y").count() == 6000
    a = V.export_sample(big, 123, ["id"])
    b = V.export_sample(big.repartition(7), 123, ["id"])  # the sample depends on the rows alone
    assert a.count() == 123 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert V.scatter(big, "id", "y", size=50, keys=["id"]).count() == 50
    assert V.chart_series(big, {"type": "bar", "x": "z", "y": "y"}).count() == 6000
    text = V.render_text(spark.createDataFrame([(1, None)], "a int, b string")).first()
    assert (text["a"], text["b"]) == ("1", "")
