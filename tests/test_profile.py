import numpy as np

from tabprobe.operators import profile as P


def test_profile_values(boats_df):
    rows = {r["name"]: r for r in P.profile(boats_df).collect()}
    assert set(rows) == {"boat", "length", "sail", "rig"}
    assert rows["sail"]["null_count"] == 1 and rows["sail"]["null_pct"] == 16.67
    assert rows["length"]["min"] == 9.0 and rows["length"]["max"] == 21.0
    assert rows["length"]["median"] == 13.0  # mean of the two middle values
    assert rows["sail"]["unique_count"] == 6  # 5 values + null
    assert [(t["value"], t["count"]) for t in rows["rig"]["top_values"]] == [("sloop", 3), ("ketch", 2), ("yawl", 1)]
    assert rows["length"]["top_values"] is None


def test_small_answers(boats_df):
    assert P.memory_estimate(boats_df).first()["estimated_bytes"] > 0
    r = P.column_split(boats_df).first()
    assert (r["n_numeric"], r["n_categorical"]) == (2, 2)
    full = {r["name"]: r for r in P.profile(boats_df).collect()}
    assert {x["name"]: x["unique_count"] for x in P.cardinality(boats_df).collect()} == {n: r["unique_count"] for n, r in full.items()}
    for q in P.quick_profile(boats_df).collect():
        assert all(q[k] == full[q["name"]][k] for k in ("dtype", "null_count", "unique_count", "mean", "min", "max"))


def test_distinct_values_keep_their_precision(spark):
    df = spark.sql("""SELECT CAST(x AS decimal(20,0)) AS d, timestamp_micros(m) AS t, CAST(t AS binary) AS b, map(k, v) AS m FROM VALUES
        (12345678901234567890, 1, 'a', 'k', 1), (12345678901234567891, 2, 'b', 'k', 2), (12345678901234567892, 2, 'b', 'k', 1)
        AS v(x, m, t, k, v)""")
    got = {r["name"]: r["unique_count"] for r in P.profile(df).collect()}
    assert got == {"d": 3, "t": 2, "b": 2, "m": 2}


def test_profile_approx(boats_df):
    rows = {r["name"]: r for r in P.profile(boats_df, exact=False).collect()}
    assert rows["length"]["unique_count"] == 6


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    rows = {r["name"]: r for r in P.profile(df).collect()}
    assert rows["a"]["null_pct"] == 0.0 and rows["a"]["mean"] is None


def test_wide_table_medians(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(-1000, 1000, size=(301, 60)).astype(float)
    data[::7, 3] = np.nan  # NaN values in one column
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(float(x) for x in row) for row in data], ", ".join(f"{c} double" for c in cols))
    rows = {r["name"]: r for r in P.profile(df).collect()}
    for i in (0, 17, 59):
        assert rows[f"c{i}"]["median"] == round(float(np.median(data[:, i])), 4)
    assert rows["c3"]["max"] == float(np.nanmax(data[:, 3]))
