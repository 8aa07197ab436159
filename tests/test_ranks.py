import numpy as np
import pandas as pd

from tabprobe.functions.ranks import average_ranks


def test_average_ranks_match_pandas(spark):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 30000, size=40000).astype(float)  # many distinct values: several Arrow batches per partition
    b = rng.integers(0, 5, size=40000).astype(float)      # heavy ties
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf)
    got = average_ranks(df, ["a", "b"], partitions=3).toPandas()
    for c in ("a", "b"):
        expect = pd.DataFrame({"value": pdf[c], "r": pdf[c].rank(method="average")}).drop_duplicates("value")
        m = got[got.column_name == c].merge(expect, on="value")
        assert len(m) == pdf[c].nunique()
        assert np.allclose(m["avg_rank"], m["r"])
