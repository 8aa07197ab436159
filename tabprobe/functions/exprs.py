"""Column helpers: type tests, quoting, safe rounding, text rendering of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Reference a column by its exact name (dots, spaces and backticks allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    """The one type test the analysis branches on: ints, floats and decimals (not boolean)."""
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def nan_to_null(c: Column, dt: T.DataType | None = None) -> Column:
    """NaN becomes null; other values pass through (only floats can hold NaN)."""
    if dt is not None and not is_fractional(dt):
        return c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_round(c: Column, decimals: int = 4) -> Column:
    """Round a statistic to ``decimals``; NaN and infinities become null."""
    d = c.cast("double")
    finite = F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)
    return F.round(finite, decimals)


def as_text(c: Column, dt: T.DataType) -> Column:
    """Render a value as text: nested types as JSON, everything else by cast."""
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


# Fixed storage widths in bytes used by the memory estimate (our own definition:
# fixed width times rows, plus the UTF-8 bytes of variable-width values).
FIXED_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def fixed_width(dt: T.DataType) -> int | None:
    for cls, width in FIXED_WIDTH.items():
        if isinstance(dt, cls):
            return width
    return None
