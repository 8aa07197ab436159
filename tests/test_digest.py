from tabprobe.operators import clean as C, digest as D, eda as E, profile as P


def test_digest_and_flags(boats_df):
    prof = P.profile(boats_df)
    outl = E.outliers(boats_df)
    corr = E.correlation(boats_df)
    _, actions = C.clean(boats_df)
    lines = [r["text"] for r in D.digest("boats", 6, 4, prof, outl, corr, actions).orderBy("line").collect()]
    assert lines[0] == "Dataset: boats (6×4)"
    assert lines[1].startswith("Numeric: length(bigint,6u)[μ=14.0], sail(double,6u,1n)")
    assert lines[2] == "Categorical: boat(string,6u), rig(string,3u)"
    assert any(x.startswith("Cleaning: fill_null_median(sail)") for x in lines)
    flags = {(r["column_name"], r["flag"]) for r in D.quality_flags(prof, boats_df).collect()}
    assert ("boat", "key_like") in flags
    assert not D.is_empty(boats_df)
