import os

from tabprobe.plans.analyze import analyze, analyze_path


def test_analyze_tables(spark, boats_csv):
    df = spark.read.csv(boats_csv, header=True, inferSchema=True)
    res = analyze(df, name="boats.csv",
                  query_instructions=[{"filter_conditions": ["length > 10"], "groupby_columns": ["rig"],
                                       "aggregations": {"sail_area": "mean"}}],
                  chart_instructions=[{"type": "bar", "x": "rig", "y": "sail_area", "title": "pay"}])
    assert res.stopped is None
    assert {"profile", "actions", "cleaned", "numeric_summary", "correlation", "outliers", "digest",
            "quality_flags"} <= set(res.tables)
    assert res.tables["cleaned"].columns == ["boat", "length", "sail_area", "rig", "launched"]
    assert res.tables["cleaned"].where("length IS NULL OR sail_area IS NULL").count() == 0
    assert res.query_results[0].count() == 3 and "pay" in res.charts
    first = res.tables["digest"].orderBy("line").first()["text"]
    assert first == "Dataset: boats.csv (7×5)"


def test_empty_gate(spark):
    res = analyze(spark.createDataFrame([], "a double"))
    assert res.stopped == "no rows"


def test_resume_from_store(spark, boats_csv, tmpdir_path):
    root = os.path.join(tmpdir_path, "cache")
    given = {"query_instructions": [{"groupby_columns": ["rig"], "aggregations": {"length": "max"}}, {"filter_conditions": ["zz > 1"]}],
             "chart_instructions": [{"type": "bar", "x": "rig", "title": "a/b c"}, {"type": "pie"}]}
    first = analyze_path(spark, boats_csv, cache_root=root, **given)
    again = analyze_path(spark, boats_csv, cache_root=root, **given)
    assert sorted(again.tables) == sorted(first.tables) and list(again.charts) == ["a/b c"]
    assert again.warnings == first.warnings and len(first.warnings) == 2
    assert [q is None for q in again.query_results] == [False, True]
    assert sorted(again.query_results[0].collect()) == sorted(first.query_results[0].collect())
    a = sorted(tuple(r) for r in first.tables["numeric_summary"].collect())
    b = sorted(tuple(r) for r in again.tables["numeric_summary"].collect())
    assert a == b
    other = analyze_path(spark, boats_csv, cache_root=root, outlier_method="zscore")  # other options: recomputed
    assert other.tables["outliers"].count() == first.tables["outliers"].count()
    with open(boats_csv, "a") as fh:
        fh.write("Wren,8,300.0,yawl,2020-02-02\n")
    assert analyze_path(spark, boats_csv, cache_root=root, **given).tables["cleaned"].count() == first.tables["cleaned"].count() + 1
