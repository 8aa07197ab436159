"""DuckDB SQL that states each driver query's expected result independently.

Per-column SQL is generated from the column list: one SELECT per column joined by
UNION ALL, written with DuckDB's own aggregates and window functions.
"""

from __future__ import annotations

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
LINEITEM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                  "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                  "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
              "p_retailprice": "double"}
CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                  "c_mktsegment": "string"}
DOCLABEL_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
                  "quality": "int", "toxic": "int"}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")

DOCLABEL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
MASKED_LINEITEM = "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount) FROM lineitem)"
MASKED_ORDERS = ("(SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority, "
                 "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus) FROM orders)")


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def profile_sql(table: str, types: dict[str, str]) -> str:
    parts = []
    for pos, (c, t) in enumerate(types.items()):
        num = t in NUMERIC
        x = f"CAST({c} AS DOUBLE)"
        if num:
            mean, med, std, mn, mx = (f"round(avg({x}), 4)", f"round(median({x}), 4)", f"round(stddev_samp({x}), 4)",
                                      f"round(min({x}), 4)", f"round(max({x}), 4)")
        else:
            mean = med = std = mn = mx = "NULL::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS name, '{t}' AS dtype, count(*) - count({c}) AS null_count, "
            f"round(coalesce((count(*) - count({c})) * 100.0::DOUBLE / nullif(count(*), 0), 0.0), 2) AS null_pct, "
            f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS unique_count, "
            f"{mean} AS mean, {med} AS median, {std} AS std, {mn} AS min, {mx} AS max, {pos} AS position FROM {table} t")
    return union(parts)


def top_values_sql(table: str, cols: list[str], k: int = 10) -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table} t "
             f"WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in cols]
    return (f"SELECT column_name, rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY column_name "
            f"ORDER BY count DESC, value ASC) AS rank FROM ({union(parts)})) WHERE rank <= {k}")


def ranked(table: str, c: str) -> str:
    return (f"(SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS rn, count(*) OVER () AS n "
            f"FROM {table} t WHERE {c} IS NOT NULL)")


def nearest(q: float) -> str:
    return f"floor((n - 1) * {q} + 0.5)"


def numeric_summary_sql(table: str, cols: list[str], positions: dict[str, int] | None = None) -> str:
    parts = []
    for i, c in enumerate(cols):
        pos = positions[c] if positions else i
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, {pos} AS position, (SELECT count({c}) FROM {table} t) AS n, "
            f"(SELECT round(avg({x}), 4) FROM {table} t) AS mean, "
            f"(SELECT round(median({x}), 4) FROM {table} t) AS median, "
            f"(SELECT round(stddev_samp({x}), 4) FROM {table} t) AS std, "
            f"(SELECT round(min({x}), 4) FROM {table} t) AS min, (SELECT round(max({x}), 4) FROM {table} t) AS max, "
            f"(SELECT round(max(CASE WHEN rn = {nearest(0.25)} THEN v END), 4) FROM {ranked(table, c)}) AS q25, "
            f"(SELECT round(max(CASE WHEN rn = {nearest(0.5)} THEN v END), 4) FROM {ranked(table, c)}) AS q50, "
            f"(SELECT round(max(CASE WHEN rn = {nearest(0.75)} THEN v END), 4) FROM {ranked(table, c)}) AS q75, "
            f"(SELECT round(CASE WHEN s IS NULL OR s = 0 THEN NULL ELSE m3 / power(s, 3) END, 4) FROM "
            f"(SELECT avg(power({x} - mu, 3)) AS m3, max(s) AS s FROM {table} t, "
            f"(SELECT avg({x}) AS mu, stddev_samp({x}) AS s FROM {table} t) mm)) AS skew")
    return union(parts)


def pearson_sql(table: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN count(*) = count({a}) AND "
                         f"count(*) = count({b}) THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, 4) AS r "
                         f"FROM {table} t")
    return union(parts)


def avg_rank_table(table: str, cols: list[str]) -> str:
    sel = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols)
    return f"(SELECT {sel} FROM {table} t)"


def outliers_iqr_sql(table: str, cols: list[str], t: float = 1.5) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        q = (f"(SELECT max(CASE WHEN rn = {nearest(0.25)} THEN v END) AS q1, "
             f"max(CASE WHEN rn = {nearest(0.75)} THEN v END) AS q3, max(n) AS n FROM {ranked(table, c)})")
        b = f"(SELECT q1 - {t} * (q3 - q1) AS lo, q3 + {t} * (q3 - q1) AS hi, n FROM {q})"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, "
            f"CASE WHEN n >= 4 THEN (SELECT count(*) FROM {table} t WHERE {x} < lo OR {x} > hi) ELSE 0 END AS count, "
            f"CASE WHEN n >= 4 THEN round((SELECT count(*) FROM {table} t WHERE {x} < lo OR {x} > hi) / n * 100.0::DOUBLE, 2) "
            f"ELSE 0.0 END AS pct, CASE WHEN n >= 4 THEN round(lo, 4) END AS lower, "
            f"CASE WHEN n >= 4 THEN round(hi, 4) END AS upper FROM {b}")
    return union(parts)


def outliers_z_sql(table: str, cols: list[str], t: float = 1.5) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        s = f"(SELECT avg({x}) AS mu, stddev_samp({x}) AS s, count({c}) AS n FROM {table} t)"
        ok = "n >= 4 AND s IS NOT NULL AND s <> 0"
        cnt = f"(SELECT count(*) FROM {table} t WHERE abs(({x} - mu) / s) > {t})"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, CASE WHEN {ok} THEN {cnt} ELSE 0 END AS count, "
            f"CASE WHEN {ok} THEN round({cnt} / n * 100.0::DOUBLE, 2) ELSE 0.0 END AS pct, "
            f"CASE WHEN {ok} THEN round(mu - {t} * s, 4) END AS lower, CASE WHEN {ok} THEN round(mu + {t} * s, 4) END AS upper "
            f"FROM {s}")
    return union(parts)
