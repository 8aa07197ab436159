import numpy as np
import pytest

from tabprobe.operators import eda as E


def test_summary(spark):
    df = spark.createDataFrame([(float(i), float(10 - i)) for i in range(1, 6)], "a double, b double")
    rows = {r["column_name"]: r for r in E.numeric_summary(df).collect()}
    assert rows["a"]["mean"] == 3.0 and rows["a"]["min"] == 1.0 and rows["a"]["max"] == 5.0
    assert (rows["a"]["q25"], rows["a"]["q50"], rows["a"]["q75"]) == (2.0, 3.0, 4.0)


def test_quantiles_and_skew_vs_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.exponential(size=101), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = E.numeric_summary(df).first()
    s = np.sort(x)
    n = len(x)
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert r[name] == round(float(s[int(np.floor((n - 1) * q + 0.5))]), 4)
    sd = x.std(ddof=1)
    skew = np.mean((x - x.mean()) ** 3) / sd ** 3
    assert abs(r["skew"] - skew) < 1e-3


def test_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0) for i in range(5)], "x double, y double, c double")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in E.correlation(df).collect()}
    assert abs(r[("x", "y")] - 1.0) < 1e-3 and r[("y", "x")] == r[("x", "y")]
    assert r[("x", "c")] is None  # constant column
    sp = {(x["col_a"], x["col_b"]): x["r"] for x in E.correlation(df, ["x", "y"], method="spearman").collect()}
    assert sp[("x", "y")] == 1.0


def test_correlation_null_policy(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.1, None), (3.0, 6.3, 3.0), (4.0, 7.9, 4.0)],
                               "a double, b double, c double")
    prop = {(x["col_a"], x["col_b"]): x["r"] for x in E.correlation(df).collect()}
    assert prop[("a", "c")] is None and prop[("c", "c")] is None and prop[("a", "b")] is not None
    pair = {(x["col_a"], x["col_b"]): x["r"] for x in E.correlation(df, nulls="pairwise").collect()}
    assert pair[("a", "c")] == 1.0
    with pytest.raises(ValueError):
        E.correlation(df, method="spearman", nulls="pairwise")


@pytest.mark.parametrize("nulls", ["propagate", "pairwise"])
def test_pearson_in_column_blocks(spark, monkeypatch, nulls):
    assert all(any({i, j} <= set(g) for g in E._column_groups(2500)) for i in (0, 511, 512, 1999) for j in (0, 700, 1024, 2499))
    assert max(map(len, E._column_groups(2500))) == E.WIDTH and len(E._column_groups(1024)) == 1
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 11)).cumsum(axis=1)
    rows = [[None if (i + j) % 9 == 0 and j % 3 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(11)))
    whole = E.correlation(df, nulls=nulls).collect()
    monkeypatch.setattr(E, "WIDTH", 4)
    assert E.correlation(df, nulls=nulls).collect() == whole and len(whole) == 121
    assert sum(r["r"] is not None for r in whole) == (121 if nulls == "pairwise" else 49)


def test_wide_pearson_is_one_pass_and_matches_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 30)) * 10.0 ** rng.integers(-3, 6, 30) + 1e6
    x[:, 7] = 0.1
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in E.correlation(df).collect()}
    want = np.corrcoef(np.delete(x, 7, axis=1), rowvar=False)
    keep = [c for c in cols if c != "c7"]
    assert all(abs(got[a, b] - want[i, j]) < 2e-4 for i, a in enumerate(keep) for j, b in enumerate(keep))
    assert all(got["c7", c] is None for c in cols)


def test_spearman_with_ties_and_hot_values(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    data = pd.DataFrame({"a": np.where(rng.random(300) < 0.6, 0.0, rng.integers(0, 9, 300)), "b": rng.integers(0, 5, 300).astype(float)})
    data["c"] = data.a * 2 - data.b + rng.normal(size=300)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in E.correlation(spark.createDataFrame(data), method="spearman").collect()}
    want = data.rank().corr()
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-4 for a in data for b in data)


def test_outliers(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 2.0, 3.0, 100.0]], "val double")
    r = E.outliers(df).first()
    assert r["count"] >= 1 and r["pct"] == 16.67
    z = E.outliers(df, method="zscore", threshold=1.5).first()
    assert z["count"] == 1
    few = spark.createDataFrame([(1.0,), (2.0,), (50.0,)], "val double")
    f = E.outliers(few).first()
    assert (f["count"], f["pct"], f["lower"]) == (0, 0.0, None)
    assert E.outlier_columns(E.outliers(df)).first()["outlier_columns"] == 1


def test_categorical(spark):
    df = spark.createDataFrame([("red", 1), ("red", 2), ("blue", 3), ("green", 4), ("red", 5), ("blue", 6)],
                               "color string, size bigint")
    uniq, top = E.categorical_summary(df)
    assert {r["column_name"]: r["unique_count"] for r in uniq.collect()} == {"color": 3}
    assert [(r["value"], r["count"]) for r in top.orderBy("rank").collect()] == [("red", 3), ("blue", 2), ("green", 1)]


def test_moments_from_profile_order_stats_match(spark):
    from tabprobe.functions.stats import column_stats
    from tabprobe.operators.profile import profile

    rows = [(float(i % 17), i * 3, None if i % 5 == 0 else float(i) ** 0.5) for i in range(203)]
    df = spark.createDataFrame(rows, "a double, b bigint, c double")
    stats = column_stats(df, skew=True)
    p = profile(df, stats=stats, quartiles=True)
    shared = E.numeric_moments(df, stats=stats, order_stats=p.order_stats)
    fresh = E.numeric_moments(df)
    for c in ("a", "b", "c"):
        for k in ("median", "q25", "q50", "q75", "skew"):
            assert shared[c][k] == fresh[c][k], (c, k)


def test_zscore_outliers_without_order_statistics(spark):
    rows = [(float(i), None if i % 9 == 0 else float(i * i % 37), 5.0) for i in range(60)] + [(500.0, 400.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, flat double")
    quick = {r["column_name"]: r.asDict() for r in E.outliers(df, method="zscore", threshold=2.0).collect()}
    full = {r["column_name"]: r.asDict() for r in
            E.outliers(df, method="zscore", threshold=2.0, moments=E.numeric_moments(df)).collect()}
    assert quick == full
    assert quick["a"]["count"] == 1 and quick["flat"]["count"] == 0 and quick["flat"]["lower"] is None


def test_spearman_hot_values_and_small_parts(spark, monkeypatch):
    """Values of many rows are not shuffled by value; the others meet their ranks in parts that grow in number."""
    pd = pytest.importorskip("pandas")
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 3, 4000).astype(float), "b": rng.normal(size=4000), "c": rng.integers(0, 900, 4000).astype(float)})
    pdf.loc[:1500, "c"] = 7.0
    asked, ranked = [], E.average_ranks
    monkeypatch.setattr(E, "HOT", 500)
    monkeypatch.setattr(E, "CELLS", 1000)
    monkeypatch.setattr(E, "average_ranks", lambda df, cols, parts: asked.append(parts) or ranked(df, cols, parts))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in E.correlation(spark.createDataFrame(pdf), method="spearman").collect()}
    want = pdf.corr(method="spearman")
    assert asked == [12]
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-4 for a in pdf for b in pdf)
