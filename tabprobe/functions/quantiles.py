"""Exact order statistics (the value at a given rank) by radix histograms over 64-bit keys.

Spark's exact ``percentile``/``median`` keep every distinct value of a group in one buffer, and a
global aggregate merges them in a single task. Here every value has a 64-bit key in the same order (a long
is its own key; a double's bits, flipped below zero, with NaN last), and each pass is one aggregate
for all columns: the keys of each open interval are counted by their next bits, each bucket with its
least and greatest key. The wanted ranks fall into one bucket each.

* A bucket whose least and greatest key agree is the answer, however many rows share it.
* Otherwise the keys between them are the open interval of the next pass.
* An interval of at most ``SMALL`` values has a bucket for each of its keys, and is solved.

The tasks count their own rows first, so a task sends at most ``CELLS`` buckets for all columns
together, and nothing depends on the number of rows but the number of passes: 2 for some millions, 3
for billions of rows unless the values are bunched on several scales; never more than 64 bits ask for.
Only one row per wanted rank reaches the driver. Columns do not multiply the plan: it holds no
expression per column or interval.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import col

#: Buckets that a task may send in one pass, over all open intervals.
CELLS = 1 << 20
MOST_BITS, LEAST_BITS = 16, 6
SMALL = 4096
QUARTILES = (0.25, 0.5, 0.75)
_FLIP = (1 << 63) - 1
_NAN_KEY = 0x7FF8 << 48


def nearest_rank(n: int, q: float) -> int:
    """0-based index of the nearest-rank quantile: round((n-1)q), halves up."""
    return int(math.floor((n - 1) * q + 0.5))


def median_ranks(n: int) -> tuple[int, int]:
    """The one or two middle ranks whose mean is the median."""
    return (n - 1) // 2, n // 2


def finite_stats(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    from tabprobe.functions.stats import column_stats

    return column_stats(df.select(*[col(c) for c in cols]))


def is_long(dt: T.DataType) -> bool:
    """Integer columns keep their 64 bits; the other numbers are compared as doubles."""
    return isinstance(dt, T.IntegralType)


def double_key(v: float) -> int:
    if math.isnan(v):
        return _NAN_KEY
    bits = struct.unpack("<q", struct.pack("<d", v + 0.0))[0]  # -0.0 counts as 0.0
    return bits if bits >= 0 else bits ^ _FLIP


def key_value(key: int, long: bool) -> int | float:
    if long:
        return key
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ _FLIP))[0]


def _sorted_keys(values):
    import numpy as np

    if values.dtype == np.int64:
        keys = values.copy()
    else:
        v = values + 0.0
        keys = v.view(np.int64)
        keys = np.where(keys < 0, keys ^ np.int64(_FLIP), keys)
        keys[np.isnan(v)] = _NAN_KEY
    keys.sort()
    return keys


def _runs(buckets, counts, low, high):
    """Rows sorted by bucket, summed by bucket."""
    import numpy as np

    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets[at], np.add.reduceat(counts, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def _count_buckets(intervals: list[list[tuple[int, int, int, int, bool]]]):
    """intervals: for each column, (number, lo, hi, shift, whole); the keys of an interval are counted by
    (key - lo) >> shift. ``whole``: all keys belong to it, and lo and hi only say where most lie."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts: dict[int, list] = {}
        held = 0

        def merge(number):
            cells = [np.concatenate(x) for x in zip(*parts[number])]
            order = np.argsort(cells[0], kind="stable")
            return _runs(*[x[order] for x in cells])

        for batch in batches:
            for j, spans in enumerate(intervals):
                keys = _sorted_keys(pc.drop_null(batch.column(j)).to_numpy(zero_copy_only=False))
                for number, lo, hi, shift, whole in spans:
                    k = keys if whole else keys[np.searchsorted(keys, lo):np.searchsorted(keys, hi, "right")]
                    if not len(k):
                        continue
                    # As unsigned numbers: the distance may take all 64 bits.
                    far = np.clip(k, lo, hi).view(np.uint64) - np.array(lo, np.int64).view(np.uint64)
                    at = ((far >> np.uint64(shift)) ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the same order
                    parts.setdefault(number, []).append(_runs(at, np.ones(len(k), np.int64), k, k))
                    held += len(parts[number][-1][0])
            if held > 2 * CELLS:
                parts = {number: [merge(number)] for number in parts}
                held = sum(len(p[0][0]) for p in parts.values())
        for number in parts:
            cells = merge(number)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[0]), number, np.int32)), *map(pa.array, cells)],
                                             names=["number", "bucket", "held", "low", "high"])

    return run


def _pass(base: DataFrame, names: list[str], intervals: list[dict]) -> list[dict]:
    """One aggregate over all open intervals: for each wanted rank the bucket that holds it.

    intervals: column, lo, hi, rows, ranks (within the interval), whole. Returns for each rank
    number, rank, before (rows of the interval in lower buckets), held, low, high.
    """
    spark = base.sparkSession
    bits = max(LEAST_BITS, min(MOST_BITS, int(math.log2(CELLS / len(intervals)))))
    small = min(SMALL, CELLS // len(intervals))
    spans: dict[str, list] = {}
    for i, x in enumerate(intervals):
        shift = 0 if x["rows"] <= small else max(0, (x["hi"] - x["lo"]).bit_length() - bits)
        spans.setdefault(x["column"], []).append((i, x["lo"], x["hi"], shift, x["whole"]))
    cols = [c for c in names if c in spans]
    counted = base.select(*[F.col(c) for c in cols]).mapInArrow(
        _count_buckets([spans[c] for c in cols]), "number int, bucket bigint, held bigint, low bigint, high bigint")
    cells = counted.groupBy("number", "bucket").agg(F.sum("held").alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
    lower = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("held").over(lower), F.lit(0)))
    wanted = spark.createDataFrame([(i, r) for i, x in enumerate(intervals) for r in x["ranks"]], "number int, rank bigint")
    hit = placed.join(F.broadcast(wanted), "number").where("before <= rank and rank < before + held")
    return [r.asDict() for r in hit.collect()]


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], stats: dict[str, dict] | None = None) -> dict[str, dict[int, float | int | None]]:
    """Value at each 0-based rank among the non-null values of each column of ``df``.

    ``ranks`` maps a column name to the ranks wanted. Integer columns give integers, exact at any size;
    other values are compared as doubles in Spark's order (-inf < finite < +inf < NaN).
    Ranks outside [0, n) give None.
    """
    cols = [c for c in ranks if ranks[c]]
    out: dict[str, dict[int, float | int | None]] = {c: {} for c in ranks}
    if not cols:
        return out
    if stats is None:
        stats = finite_stats(df, cols)
    long = {c: is_long(df.schema[c].dataType) for c in cols}
    names = {c: f"_q{i}" for i, c in enumerate(cols)}
    back = {v: k for k, v in names.items()}
    base = df.select(*[col(c).cast("bigint" if long[c] else "double").alias(names[c]) for c in cols])
    open_ = []
    for c in cols:
        s = stats[c]
        for k in ranks[c]:
            if not 0 <= k < s["n"]:
                out[c][k] = None
        inside = sorted({k for k in ranks[c] if 0 <= k < s["n"]})
        if not inside:
            continue
        ends = [_NAN_KEY] * 2 if s["fmin"] is None else \
            [max(-_FLIP, min(_FLIP, int(v))) if long[c] else double_key(v) for v in (s["fmin"], s["fmax"])]
        open_.append({"column": names[c], "lo": ends[0], "hi": ends[1], "rows": s["n"], "whole": True, "ranks": inside,
                      "asked": {k: [k] for k in inside}})
    while open_:
        # Past CELLS / 2 ** LEAST_BITS open intervals a pass takes them in turns.
        most = CELLS >> LEAST_BITS
        found, again = [], {}
        for start in range(0, len(open_), most):
            part = open_[start:start + most]
            found += [(part[r["number"]], r) for r in _pass(base, list(back), part)]
        for x, r in found:
            for k in x["asked"][r["rank"]]:
                c = back[x["column"]]
                if r["low"] == r["high"]:
                    out[c][k] = key_value(r["low"], long[c])
                    continue
                at = again.setdefault((c, r["low"]), {"column": x["column"], "lo": r["low"], "hi": r["high"], "rows": r["held"], "whole": False, "asked": {}})
                at["asked"].setdefault(r["rank"] - r["before"], []).append(k)
        open_ = [x | {"ranks": sorted(x["asked"])} for x in again.values()]
    return out
