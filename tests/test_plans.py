"""Physical-plan properties the scale design relies on (read from ``explain``).

Filters and column pruning reach the Parquet scan; aggregates combine map-side
before their shuffle; top-k per column is a two-phase WindowGroupLimit; bars are a
TakeOrderedAndProject. The plans are taken on the smallest bundled table.
"""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tabprobe.functions import values
from tabprobe.operators import charts, clean, profile as prof, query

SF = "/root/testdata/sf0.001"


def plan(df, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.fixture()
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_filter_reaches_scan_and_prunes_columns(lineitem):
    p = plan(query.filter_rows(lineitem, ["l_quantity > 30", "l_returnflag = 'R'"]).select("l_orderkey", "l_quantity"),
             "formatted")
    assert "GreaterThan(l_quantity,30" in p and "EqualTo(l_returnflag,R)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p


def test_group_by_aggregates_map_side(lineitem):
    out, _ = query.aggregate(lineitem, ["l_returnflag"], {"l_extendedprice": "mean", "l_quantity": "sum"})
    p = plan(out)
    assert "partial_avg(l_extendedprice" in p and "partial_sum(l_quantity" in p
    assert p.index("Exchange hashpartitioning(l_returnflag") < p.index("partial_avg")


def test_distinct_keys_combine_before_shuffle(spark):
    p = plan(prof.distinct_keys(spark.read.parquet(f"{SF}/orders.parquet")))
    assert p.count("HashAggregate") == 2 and "Exchange hashpartitioning(position" in p
    assert "o_orderstatus" not in p[:p.index("Exchange")]  # no cell crosses the shuffle


def test_top_values_shuffle_keys_and_heads_only(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(values, "materialize", lambda df, name="": plans.append(plan(df)) or df)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    values.top_values(docs, ["text", "lang"], 10)
    p = plans[0]
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p
    exchanges = [line for line in p.splitlines() if "Exchange" in line]
    assert exchanges and all("text" not in line and "value" not in line for line in exchanges)
    assert "substring(" in p and "keys=[position" in p


def test_mode_lookup(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderstatus", "o_orderpriority")
    modes = clean._mode_values(orders, ["o_orderstatus"], {"o_orderstatus": F.lit(True)})
    counts = orders.groupBy("o_orderstatus").count().collect()
    best = min(counts, key=lambda r: (-r["count"], r["o_orderstatus"]))
    assert modes["o_orderstatus"] == best["o_orderstatus"]


def test_bars_take_ordered(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    p = plan(charts.bar_mean(part, "p_brand", "p_retailprice"))
    assert "TakeOrderedAndProject(limit=15" in p
