"""Column expressions on raw text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Space, tab, line feed, vertical tab, form feed, carriage return: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    On a text of ASCII alone ``lower`` does just that and is much faster than ``translate``.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def key128(text: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes; together they name a text among 10^15 others."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
