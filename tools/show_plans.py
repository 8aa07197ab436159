"""Print the physical plans of key catalogue queries (``explain("formatted")`` heads).

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabprobe.functions.values import top_k, value_counts  # noqa: E402
from tabprobe.operators import charts, profile as prof, query  # noqa: E402
from tabprobe.plans.catalog import table  # noqa: E402
from tabprobe.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    li = table(spark, sf, "lineitem")
    plans = {
        "filter (Q1)": query.filter_rows(li, ["l_quantity > 30", "l_returnflag = 'R'"]).select("l_orderkey", "l_quantity"),
        "group-by (Q5)": query.aggregate(li, ["l_returnflag"], {"l_extendedprice": "mean", "l_quantity": "sum"})[0],
        "distinct keys (profile)": prof.distinct_keys(table(spark, sf, "orders")),
        "top-10 per column (P10/E5)": top_k(value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), 10),
        "bar top-15 (V2)": charts.bar_mean(table(spark, sf, "part"), "p_brand", "p_retailprice"),
    }
    for name, df in plans.items():
        print(f"### {name}\n")
        df.explain()


if __name__ == "__main__":
    main()
