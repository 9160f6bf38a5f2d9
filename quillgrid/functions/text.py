"""Text rules: blanks, spreadsheet-formula protection, column keys, value labels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what counts as white space when cells are trimmed (includes the byte-order mark).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r              "
    "    　﻿"
)

# First characters a spreadsheet would run as a formula.
FORMULA_STARTS = ["=", "+", "-", "@", "|"]

# Names that never become column keys.
FORBIDDEN_KEYS = ["__proto__", "constructor", "prototype"]

KEY_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_]*$"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (trimmed(c) == "")


def normalised(c: Column) -> Column:
    """A text cell as it enters a table: trimmed, blank becomes null."""
    return F.nullif(trimmed(c), F.lit(""))


def starts_formula(c: Column) -> Column:
    first = F.substring(F.ltrim(c, F.lit(WHITE_SPACE)), 1, 1)
    return first.isin(FORMULA_STARTS)


def neutralise(c: Column) -> Column:
    """Quote-prefix text a spreadsheet would evaluate; other text and nulls pass unchanged."""
    return F.when(starts_formula(c), F.concat(F.lit("'"), c)).otherwise(c)


def category_label(c: Column) -> Column:
    """A frequency-table label: at most 100 characters, blanks named, formulas quoted."""
    t = trimmed(c)
    return (
        F.when(c.isNull(), F.lit("null"))
        .when(t == "", F.lit("(empty)"))
        .otherwise(F.substring(neutralise(t), 1, 100))
    )


def sample_label(c: Column) -> Column:
    """A sample value: at most 40 characters, formulas quoted, blank for missing."""
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.substring(neutralise(t), 1, 40)


def _key_text(t: Column) -> Column:
    """Trimmed header text in the letters of a key."""
    k = F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1_$2")
    k = F.regexp_replace(k, r"[^a-zA-Z0-9_]", "_")
    k = F.lower(F.regexp_replace(k, r"_+", "_"))
    k = F.regexp_replace(k, r"^([0-9])", "_$1")
    return F.regexp_replace(k, r"^(.+)_$", "$1")


def _safe_key(t: Column, k: Column, position: Column) -> Column:
    numbered = F.concat(F.lit("col_"), (position + 1).cast("string"))
    k = F.when(k.isin("", "_"), numbered).when(k.isin(FORBIDDEN_KEYS), F.concat(F.lit("safe_"), k)).otherwise(k)
    return (
        F.when(t == "", numbered)
        .when(F.lower(t).isin(FORBIDDEN_KEYS), F.concat(F.lit("safe_"), F.lower(t)))
        .otherwise(F.substring(k, 1, 120))
    )


def header_key(raw: Column, position: Column) -> Column:
    """A safe column key from a header cell; ``position`` is the 0-based column index used for blank headers."""
    t = trimmed(F.coalesce(raw, F.lit("")))
    return _safe_key(t, _key_text(t), position)


def header_keys(raws: Column) -> Column:
    """`header_key` of every cell of an array. Inside a lambda nothing is computed once for several uses, so it goes in steps."""
    texts = F.transform(raws, lambda raw: trimmed(F.coalesce(raw, F.lit(""))))
    pairs = F.transform(texts, lambda t: F.struct(t.alias("t"), _key_text(t).alias("k")))
    return F.transform(pairs, lambda p, i: _safe_key(p["t"], p["k"], i))


def _placed(keys: list[str | None]) -> list[str | None]:
    taken, tried, out = set(), {}, []
    for key in keys:
        name, n = key, tried.get(key, 0)
        # Suffixes tried before are still taken.
        if n:
            name = f"{key}_{n}"
        while key is not None and name in taken:
            n += 1
            name = f"{key}_{n}"
        tried[key] = n
        taken.add(name)
        out.append(name)
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _told_apart(keys: pa.Array) -> pa.Array:
    return pa.array([x and _placed(x) for x in keys.to_pylist()], pa.list_(pa.string()))


def unique_keys(keys: Column) -> Column:
    """Resolve repeated keys in a header array with the first free ``_1``, ``_2`` ... suffix, left to right.

    Later keys must see earlier results (``a, a, a_1`` gives ``a, a_1, a_1_1``), so headers with repeats are gone through in
    sequence, in Python with a set of what is taken: time grows with the keys, however many repeat.
    """
    repeats = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeats, _told_apart(F.when(repeats, keys))).otherwise(keys)


def plain_number(c: Column) -> Column:
    """A double as people write it: no exponent for ordinary sizes and no trailing ``.0``."""
    d = c.cast("double")
    short = d.cast("string")
    exact = short.try_cast("decimal(38,18)").cast("string")
    return (
        F.when((d == F.rint(d)) & (F.abs(d) < 1e18), d.try_cast("bigint").cast("string"))
        .when((F.abs(d) >= 1e-6) & (F.abs(d) < 1e18), F.regexp_replace(exact, r"0+$", ""))
        .otherwise(short)
    )


def as_text(c: Column, dtype: T.DataType) -> Column:
    """The text of a typed cell; dates and timestamps become ISO 8601 in UTC sessions."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return plain_number(c)
    if isinstance(dtype, T.DecimalType):
        s = c.cast("string")
        return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")
