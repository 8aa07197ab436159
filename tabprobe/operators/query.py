"""Filters, projections and group-by aggregation from instruction records (Q1-Q10)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.conditions import condition_column, split_conditions
from tabprobe.functions.exprs import col
from tabprobe.session import materialize

AGG_OPS = ("mean", "sum", "count", "min", "max")


@dataclass
class QueryInstruction:
    """``{filter_conditions, groupby_columns, aggregations}`` as a record."""

    filter_conditions: list = field(default_factory=list)
    groupby_columns: list[str] = field(default_factory=list)
    aggregations: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> "QueryInstruction":
        return cls(list(d.get("filter_conditions", []) or []), list(d.get("groupby_columns", []) or []),
                   dict(d.get("aggregations", {}) or {}))


def filter_rows(df: DataFrame, conditions: list) -> DataFrame:
    """Q1: keep rows meeting every condition (AND). Catalyst pushes the predicates
    into the Parquet scan."""
    out = df
    for cond in conditions:
        for part in split_conditions(cond) if isinstance(cond, str) else [cond]:
            out = out.where(condition_column(part, df.columns))
    return out


def agg_column(c: str, op: str, where: Column | None = None) -> Column | None:
    """Q2-Q6: the aggregate for one (column, op), named ``{column}_{op}``; over the rows that meet ``where``."""
    x = col(c) if where is None else F.when(where, col(c))
    if op == "mean":
        e = F.avg(x)
    elif op == "sum":
        e = F.coalesce(F.sum(x), F.lit(0))  # an all-null group sums to 0
    elif op == "count":
        e = F.count(F.lit(1))  # row count of the group
    elif op == "min":
        e = F.min(x)
    elif op == "max":
        e = F.max(x)
    else:
        return None
    return e.alias(f"{c}_{op}")


def aggregate(df: DataFrame, groupby_columns: list[str], aggregations: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """Q5, Q7: one group-by with one aggregate per column. Unknown aggregate
    columns or operations are skipped with a warning; an unknown group column
    skips the instruction."""
    warnings = []
    missing = [g for g in groupby_columns if g not in df.columns]
    if missing:
        return None, [f"unknown group column(s) {missing}"]
    exprs = []
    for c, op in aggregations.items():
        if c not in df.columns:
            warnings.append(f"unknown aggregate column {c!r} skipped")
            continue
        e = agg_column(c, op)
        if e is None:
            warnings.append(f"unknown aggregation {op!r} for {c!r} skipped")
            continue
        exprs.append(e)
    if not groupby_columns or not exprs:
        return None, warnings + ["nothing to aggregate"]
    return df.groupBy(*[col(g) for g in groupby_columns]).agg(*exprs), warnings


def run_instruction(df: DataFrame, inst: QueryInstruction | dict) -> tuple[DataFrame | None, list[str]]:
    """Filter, then aggregate when the instruction groups; else the filtered rows."""
    if isinstance(inst, dict):
        inst = QueryInstruction.from_dict(inst)
    filtered = filter_rows(df, inst.filter_conditions)
    if inst.groupby_columns or inst.aggregations:
        return aggregate(filtered, inst.groupby_columns, inst.aggregations)
    return filtered, []


def _shared(df: DataFrame, instructions: dict[int, QueryInstruction]) -> dict[int, DataFrame]:
    """The results of several grouping instructions from one scan and one aggregate.

    A row is tagged with each instruction whose conditions it meets; the groups are (instruction, group
    columns, null where an instruction does not use one), and each aggregate sees the rows of the instructions that
    ask for it. The groups of all instructions are stored as one table, which the results read.
    """
    fits = []
    for i, inst in instructions.items():
        conditions = [condition_column(part, df.columns) for cond in inst.filter_conditions
                      for part in (split_conditions(cond) if isinstance(cond, str) else [cond])]
        met = F.lit(True)
        for c in conditions:
            met = met & c
        fits.append(F.when(met, F.lit(i)))
    keys = list(dict.fromkeys(g for inst in instructions.values() for g in inst.groupby_columns))
    asked: dict[tuple[str, str], list[int]] = {}
    for i, inst in instructions.items():
        for c, op in inst.aggregations.items():
            if c in df.columns and op in AGG_OPS:
                asked.setdefault((c, op), []).append(i)
    values = list(dict.fromkeys(c for c, _ in asked))
    tagged = df.select(F.explode(F.array_compact(F.array(*fits))).alias("i"), *[col(g).alias(f"g{j}") for j, g in enumerate(keys)],
                       *[col(c).alias(f"v{j}") for j, c in enumerate(values)])
    group = [F.when(F.col("i").isin([i for i, inst in instructions.items() if g in inst.groupby_columns]), F.col(f"g{j}")).alias(f"g{j}")
             for j, g in enumerate(keys)]
    tagged = tagged.select("i", *group, *[f"v{j}" for j in range(len(values))])
    aggs = [agg_column(f"v{values.index(c)}", op, F.col("i").isin(users)).alias(f"a{j}") for j, ((c, op), users) in enumerate(asked.items())]
    groups = materialize(tagged.groupBy("i", *[f"g{j}" for j in range(len(keys))]).agg(*aggs), "batch_groups")
    names = list(asked)
    return {i: groups.where(F.col("i") == i).select(
        *[F.col(f"g{keys.index(g)}").alias(g) for g in inst.groupby_columns],
        *[F.col(f"a{names.index((c, op))}").alias(f"{c}_{op}") for c, op in inst.aggregations.items() if (c, op) in asked])
        for i, inst in instructions.items()}


def run_batch(df: DataFrame, instructions: list) -> tuple[list[DataFrame | None], list[str]]:
    """Q8: each instruction on the same input, independently. Two or more grouping instructions share
    one scan and one aggregate, run at once; the others are lazy plans. An instruction
    that cannot be read gives None and a warning; the others still run."""
    results, warnings, grouping = [], [], {}
    for i, inst in enumerate(instructions):
        try:
            inst = QueryInstruction.from_dict(inst) if isinstance(inst, dict) else inst
            out, w = run_instruction(df, inst)
            if out is not None and inst.groupby_columns:
                grouping[i] = inst
        except (ValueError, TypeError, AttributeError) as e:
            out, w = None, [str(e)]
        results.append(out)
        warnings += [f"instruction {i}: {x}" for x in w]
    if len(grouping) > 1:
        for i, out in _shared(df, grouping).items():
            results[i] = out
    return results, warnings


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q9."""
    return df.select(*[col(c) for c in cols])


def drop_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q10: rows where every chosen column is non-null (NaN is kept: it is not null)."""
    cond = None
    for c in cols:
        e = col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df if cond is None else df.where(cond)
