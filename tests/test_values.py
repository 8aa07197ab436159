"""Most frequent values by key and head, against counting; samples by cutoff; duplicates by digest; batches in one scan."""

import contextlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabprobe.functions import values
from tabprobe.operators import charts, clean, query


def brute(cells, k):
    counts = Counter(c for c in cells if c is not None)
    return [(v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]]


@pytest.mark.parametrize("fetch", [100_000, 0])
def test_top_values_against_counting(spark, monkeypatch, fetch):
    monkeypatch.setattr(values, "FETCH", fetch)
    long = "a common opening of more than thirty-two characters, then "
    texts = [long + "b"] * 3 + [long + "a"] * 3 + [long + f"tail {i:03d}" for i in range(40)] + ["short"] * 3 + [None, "", "é" * 40, long[:32], long[:32]]
    names = [f"n{i % 6}" if i % 5 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, names, [None] * len(texts))), "text string, `a.b` string, none string").repartition(3)
    for k in (1, 4, 7, 60):
        got = {}
        for r in values.top_values(df, df.columns, k).orderBy("column_name", "rank").collect():
            got.setdefault(r["column_name"], []).append((r["value"], r["count"]))
        assert got == {"text": brute(texts, k), "a.b": brute(names, k)}
    kept = values.top_values(df, ["text"], 1, {"text": F.col("text").startswith("short")}).collect()
    assert [(r["value"], r["count"]) for r in kept] == [("short", 3)]
    assert values.top_values(df, [], 3).count() == 0


def test_samples_by_cutoff_are_the_smallest_digests(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS part", "cast(id as string) AS name").repartition(5)
    import hashlib

    want = sorted(range(5000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:40]
    assert sorted(r["id"] for r in charts.sample_rows(df, 40, ["id"]).collect()) == sorted(want)
    assert charts.sample_rows(df, 40, ["part"]).count() == 40  # three digests in all
    assert charts.sample_rows(df, 6000).count() == 5000 and charts.sample_rows(df.where("id < 0"), 5).count() == 0


def test_duplicates_by_digest(spark, monkeypatch):
    nan = float("nan")
    rows = [(i, float(i), "x" * i) for i in range(50)] + [(3, 3.0, "xxx")] * 4 + [(1, nan, None)] * 3 + [(1, 0.0, "z"), (1, -0.0, "z")]
    rows += [(None, 1.0, "a"), (1, None, "a"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a int, `b.c` double, c string").repartition(4)
    want = sorted(map(str, df.dropDuplicates().withColumn("b.c", F.col("`b.c`") + 0.0).collect()))
    for most in (1_000_000, 0):
        monkeypatch.setattr(clean, "BROADCAST_DIGESTS", most)
        out, action = clean.drop_duplicates(df)
        assert sorted(map(str, out.withColumn("b.c", F.col("`b.c`") + 0.0).collect())) == want
        assert action.rows_affected == len(rows) - len(want)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        clean._dedup(df.dropDuplicates()).explain()
    assert "c#" in buf.getvalue() and clean.drop_duplicates(df.limit(0))[1] is None


def test_batch_shares_one_scan(spark, monkeypatch):
    rows = [(f"k{i % 4}", i % 3, float(i) if i % 7 else None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, `g.h` int, v double, w int")
    batch = [{"groupby_columns": ["k"], "aggregations": {"v": "mean", "w": "count"}},
             {"filter_conditions": ["w > 50"], "groupby_columns": ["k", "g.h"], "aggregations": {"v": "sum", "nope": "sum"}},
             {"groupby_columns": ["g.h"], "aggregations": {"w": "max", "v": "min"}}, {"filter_conditions": ["w > 90"]},
             {"filter_conditions": ["w > 1000"], "groupby_columns": ["k"], "aggregations": {"w": "sum"}}, {"groupby_columns": ["zz"], "aggregations": {"w": "sum"}}]
    plans, run = [], query.materialize

    def seen(out, name):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain()
        plans.append(buf.getvalue())
        return run(out, name)

    monkeypatch.setattr(query, "materialize", seen)
    got, warnings = query.run_batch(df, batch)
    assert len(plans) == 1 and plans[0].count("Scan ExistingRDD") == 1 and "partial_" in plans[0] and len(warnings) == 2
    for inst, out in zip(batch, got):
        alone, _ = query.run_instruction(df, inst)
        assert (out is None) == (alone is None)
        if out is not None:
            assert out.columns == alone.columns and sorted(map(str, out.collect())) == sorted(map(str, alone.collect()))
