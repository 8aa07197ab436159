import math

import numpy as np
from hypothesis import given, settings, strategies as st

import tabprobe.functions.quantiles as Q
from tabprobe.functions.quantiles import median_ranks, nearest_rank, order_statistics


def test_nearest_rank():
    assert nearest_rank(5, 0.25) == 1 and nearest_rank(6, 0.5) == 3 and nearest_rank(4, 0.75) == 2
    assert median_ranks(4) == (1, 2) and median_ranks(5) == (2, 2)


def _passes(spark, vals, ranks, monkeypatch):
    calls = []
    run = Q._pass
    monkeypatch.setattr(Q, "_pass", lambda *a: calls.append(1) or run(*a))
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(4)
    got = order_statistics(df, {"v": ranks})["v"]
    monkeypatch.setattr(Q, "_pass", run)
    s = sorted(vals)
    assert all(got[k] == s[k] for k in ranks)
    return len(calls)


def test_passes_do_not_follow_the_range_of_values(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 64)
    n = 6_000
    ranks = [0, 1, n // 4, n // 2, 3 * n // 4, n - 1]
    counts = [_passes(spark, 10.0 ** np.linspace(-d, d, n), ranks, monkeypatch) for d in (0.5, 150)]
    hot = np.concatenate([np.zeros(2000), np.arange(2000.0), np.full(2000, 3.5)])
    counts.append(_passes(spark, hot, ranks, monkeypatch))
    counts.append(_passes(spark, np.append(np.random.default_rng(1).normal(size=n - 1), 1e300), ranks, monkeypatch))
    assert max(counts) <= 4, counts


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.integers(-50, 50).map(float),
                          st.floats(allow_nan=True, allow_infinity=True, width=64)), min_size=1, max_size=60))
def test_matches_sorting(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ranks = list(range(len(vals)))
    got = order_statistics(df, {"v": ranks})["v"]
    # Spark order: -inf < finite < +inf < NaN; -0.0 equals 0.0
    s = sorted(vals, key=lambda x: (1, 0.0) if math.isnan(x) else (0, x))
    for k in ranks:
        a, b = got[k], s[k]
        assert (math.isnan(a) and math.isnan(b)) or a == b, (k, a, b)


def test_longs_keep_all_bits(spark):
    rng = np.random.default_rng(11)
    vals = [int(x) for x in rng.integers(-(2 ** 63), 2 ** 63 - 1, size=2000)] + [2 ** 53 + i for i in range(40)] + [-(2 ** 63), 2 ** 63 - 1]
    df = spark.createDataFrame([(v, v % 7) for v in vals], "v bigint, w int")
    ranks = [0, 1, len(vals) // 3, len(vals) // 2, len(vals) - 1, len(vals)]
    got = order_statistics(df, {"v": ranks, "w": ranks})
    for c, s in (("v", sorted(vals)), ("w", sorted(v % 7 for v in vals))):
        assert [got[c][k] for k in ranks] == [s[k] if k < len(s) else None for k in ranks]


def test_many_columns_take_few_passes(spark, monkeypatch):
    calls = []
    run = Q._pass
    monkeypatch.setattr(Q, "_pass", lambda *a: calls.append(len(a[2])) or run(*a))
    monkeypatch.setattr(Q, "SMALL", 32)
    rng = np.random.default_rng(12)
    data = rng.normal(size=(400, 200)) * 10.0 ** rng.integers(-9, 9, size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"c{i} double" for i in range(200)))
    got = order_statistics(df, {f"c{i}": list(median_ranks(400)) for i in range(200)})
    for i in (0, 99, 199):
        s = sorted(data[:, i])
        assert [got[f"c{i}"][k] for k in (199, 200)] == [s[199], s[200]]
    assert len(calls) <= 3 and calls[0] == 200


def test_all_values_alike_or_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.5, nan, inf, None), (1.5, nan, -inf, None), (1.5, nan, nan, None)], "a double, b double, c double, d double")
    got = order_statistics(df, {"a": [0, 2], "b": [1], "c": [0, 1, 2], "d": [0]})
    assert got["a"] == {0: 1.5, 2: 1.5} and math.isnan(got["b"][1]) and got["d"] == {0: None}
    assert (got["c"][0], got["c"][1]) == (-inf, inf) and math.isnan(got["c"][2])


def test_sketched_intervals(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 16)
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 40, size=9000).astype(float), rng.exponential(size=9000)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    ranks = {"a": [0, 2224, 4449, 4450, 8999], "b": [3, 4500, 8998]}
    got = order_statistics(df, ranks)
    for c, vals in (("a", sorted(a)), ("b", sorted(b))):
        assert all(got[c][k] == vals[k] for k in ranks[c])
