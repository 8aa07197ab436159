from tabprobe.functions.names import unique_names
from tabprobe.operators import clean as C


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "a bigint, b string")
    out, actions = C.clean(df)
    assert out.count() == 3
    a = [r for r in actions.collect() if r["action"] == "drop_duplicates"][0]
    assert a["rows_affected"] == 1


def test_names(spark):
    df = spark.createDataFrame([("a", "b", 1)], "`First Name` string, `Last   Name` string, AGE bigint")
    out, action = C.normalize_columns(df)
    assert out.columns == ["first_name", "last_name", "age"]
    assert action.action == "normalize_columns"


def test_name_collisions():
    assert unique_names(["A", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert unique_names(["x", "X", "x "]) == ["x", "x_1", "x_2"]
    assert unique_names(["???", ""]) == ["column", "column_1"]


def test_fill_median(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,), (40.0,)], "val double")
    out, actions = C.handle_missing(df)
    assert [r["val"] for r in out.collect()] == [10.0, 20.0, 20.0, 40.0]
    assert actions[0].action == "fill_null_median" and actions[0].rows_affected == 1


def test_fill_mean_zero(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (6,)], "val bigint")
    out, _ = C.handle_missing(df, numeric_strategy="mean")
    assert [r["val"] for r in out.collect()] == [1.0, 2.0, 3.0, 6.0]
    out, _ = C.handle_missing(df, numeric_strategy="zero")
    assert [r["val"] for r in out.collect()] == [1, 2, 0, 6] and dict(out.dtypes)["val"] == "bigint"


def test_fill_mode_and_unknown(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "cat string")
    out, _ = C.handle_missing(df)
    assert [r["cat"] for r in out.collect()] == ["A", "A", "B", "A"]
    out, _ = C.handle_missing(df, categorical_strategy="unknown")
    assert [r["cat"] for r in out.collect()] == ["A", "A", "B", "Unknown"]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "cat string")
    out, _ = C.handle_missing(tie)
    assert [r["cat"] for r in out.collect()] == ["b", "a", "a"]  # tie -> lowest value


def test_all_null_string_gets_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    out, _ = C.handle_missing(df)
    assert [r["s"] for r in out.collect()] == ["Unknown", "Unknown"]


def test_sequential_drop(spark):
    # dropping on a removes row 2, so b's null count and median are taken on rows 1, 3, 4
    df = spark.createDataFrame([(1.0, 10.0), (None, None), (3.0, None), (4.0, 30.0)], "a double, b double")
    out, actions = C.handle_missing(df, numeric_strategy="drop")
    assert out.count() == 2
    assert [(x.column, x.rows_affected) for x in actions] == [("a", 1), ("b", 1)]


def test_coercion_order(spark):
    df = spark.createDataFrame([("1",), ("2.5",), (None,), ("1",)], "s string")
    out, actions = C.clean(df, drop_duplicates_=False)
    assert dict(out.dtypes)["s"] == "double"
    assert sorted(r["s"] for r in out.collect()) == [1.0, 1.0, 1.0, 2.5]  # filled with the string mode, then cast
    out, _ = C.clean(df, drop_duplicates_=False, categorical_strategy="unknown")
    assert dict(out.dtypes)["s"] == "string"  # 'Unknown' stops the cast
    weird = spark.createDataFrame([(" 1",), ("1d",)], "s string")
    assert dict(C.coerce_types(weird)[0].dtypes)["s"] == "string"


def test_nested_columns_with_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (array(1, 2), map('a', 1), named_struct('x', 1)), (array(1, 2), map('a', 1), named_struct('x', 1)), "
                   "(null, null, null), (array(3), map('b', 2), named_struct('x', 2)) AS v(a, m, s)")
    out, _ = C.clean(df, drop_duplicates_=False)
    got = out.selectExpr("to_json(a) AS a", "to_json(m) AS m", "to_json(s) AS s").collect()
    assert sorted(tuple(r) for r in got) == sorted([("[1,2]", '{"a":1}', '{"x":1}')] * 3 + [("[3]", '{"b":2}', '{"x":2}')])
    assert C.drop_duplicates(df)[0].count() == 3
