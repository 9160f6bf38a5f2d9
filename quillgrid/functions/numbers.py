"""Reading numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trimmed

# Fixed value: currency signs dropped before a number is read.
CURRENCY_SIGNS = "$€£¥₹"

NUMBER_TEXT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Infinity)$"
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def coerced_number(c: Column) -> Column:
    """Text coerced to a double, null when it is no number.

    Blank text counts as 0 and ``0x``/``0o``/``0b`` literals are read, which is how untyped cells compare and add up.
    Spark's own cast is guarded because it also takes ``NaN`` and ``1d``.
    """
    t = F.regexp_replace(trimmed(c), "^$", "0")
    return F.coalesce(
        F.regexp_extract(t, NUMBER_TEXT, 0).try_cast("double"),
        F.conv(F.regexp_extract(t, r"^0[xX]([0-9a-fA-F]{1,15})$", 1), 16, 10).try_cast("double"),
        F.conv(F.regexp_extract(t, r"^0[oO]([0-7]{1,20})$", 1), 8, 10).try_cast("double"),
        F.conv(F.regexp_extract(t, r"^0[bB]([01]{1,62})$", 1), 2, 10).try_cast("double"),
    )


def is_finite_number(t: Column) -> Column:
    """Whether trimmed, non-empty text coerces to a finite number, without working out radix literals."""
    written = F.abs(F.regexp_extract(t, NUMBER_TEXT, 0).try_cast("double")) < float("inf")
    return F.coalesce(written, t.rlike("^0(?:[xX][0-9a-fA-F]{1,15}|[oO][0-7]{1,20}|[bB][01]{1,62})$"))


def finite(d: Column) -> Column:
    """Null for infinities and for NaN, which Spark orders above infinity."""
    return F.when(F.abs(d) < float("inf"), d)


def fixed(d: Column, places: int) -> Column:
    """A double rounded by its exact binary value, ties away from zero.

    ``round`` decides on the shortest decimal, which turns 0.00015, stored slightly below, into 0.0002. Here the number
    is split into two halves whose products with the power of ten are exact, so the comparison with one half is too.
    """
    scale = float(10**places)
    size = F.abs(d)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    whole = F.floor(high * scale)
    up = (high * scale - whole - 0.5) + (size - high) * scale >= 0
    return F.signum(d) * (whole + up.cast("int")) / scale


def cell_number(c: Column, dtype: T.DataType) -> Column:
    """A cell of any type as a double for comparing and aggregating; null when it is no number."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.StringType):
        return coerced_number(c)
    return c.cast("double")


def parse_numeric(c: Column) -> Column:
    """Accounting text to a finite double: ``(1,234.50)`` is negative, currency signs, commas and ``%`` are dropped.

    A percentage keeps its face value (``12%`` is 12).
    """
    t = trimmed(c)
    bracketed = r"(?s)^\((.*)\)$"
    bare = trimmed(F.translate(F.regexp_replace(t, bracketed, "$1"), CURRENCY_SIGNS + ",%", ""))
    sign = F.when(t.rlike(bracketed) | bare.startswith("-"), -1.0).otherwise(1.0)
    return F.when(t != "", finite(coerced_number(F.regexp_replace(bare, "^[+-]", "")) * sign))
