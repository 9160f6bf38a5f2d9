"""Row filters: fourteen comparisons, shorthand, report bindings and dashboard controls, all as ``Column`` predicates.

A filter is a tuple ``(column, operator, value)``. Typed columns compare by type, so predicates reach the scan; only
text columns get the looser rules of untyped cells (numbers in text compare as numbers).
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import coerced_number, is_numeric
from ..functions.text import as_text

Filter = tuple[str, str, Any]

OPERATORS = [
    "eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in", "between",
    "contains", "starts_with", "ends_with", "is_null", "is_not_null",
]

# Open ends of the dashboard range controls.
DATE_RANGE_ENDS = ("1970-01-01", "2099-12-31")
NUMERIC_RANGE_ENDS = (-1e12, 1e12)

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _number(value: Any) -> float | None:
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else value
    if isinstance(value, str):
        s = value.strip()
        if s == "":
            return 0.0
        if re.fullmatch(r"[+-]?\d{1,18}", s):
            return int(s)  # a double would lose the last digits of long ids
        return float(s) if _NUMBER.fullmatch(s) else None
    return None


def _plain(value: Any) -> str:
    """The literal as a cell would be written."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def _is_written_number(value: Any) -> bool:
    """A number, or text spelled just as that number is written."""
    number = _number(value)
    if number is None or isinstance(value, bool):
        return False
    return not isinstance(value, str) or _plain(number) == value


def _is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _time_literal(value: Any) -> Column | None:
    """A date or timestamp constant (folded, so it reaches the scan), or None for text that is no ISO date."""
    if not isinstance(value, str):
        return F.lit(value) if isinstance(value, dt.date) else None
    try:
        dt.datetime.fromisoformat(value)
    except ValueError:
        return None
    return F.lit(value).cast("date" if len(value) <= 10 else "timestamp")


def _equals(c: Column, dtype: T.DataType, value: Any) -> Column:
    """Equality as of the written cell: ``5`` equals ``"5"`` but not ``"5.0"``. Never null-safe."""
    if is_numeric(dtype):
        return c == F.lit(_number(value)) if _is_written_number(value) else F.lit(False)
    if isinstance(dtype, T.BooleanType):
        text = _plain(value)
        return (c == F.lit(text == "true")) if text in ("true", "false") else F.lit(False)
    if _is_time(dtype):
        moment = _time_literal(value)
        return F.lit(False) if moment is None else c == moment
    return c == F.lit(_plain(value))


def _compares(c: Column, dtype: T.DataType, value: Any, op: str) -> Column:
    def apply(left: Column, right: Column) -> Column:
        return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]

    number = _number(value)
    if is_numeric(dtype) and number is not None:
        return apply(c, F.lit(number))
    if isinstance(dtype, T.BooleanType) and number is not None:
        return apply(c.cast("int"), F.lit(number))
    if _is_time(dtype) and _time_literal(value) is not None:
        return apply(c, _time_literal(value))
    text = as_text(c, dtype)
    if number is None or not isinstance(dtype, T.StringType):
        return apply(text, F.lit(_plain(value)))
    cell = coerced_number(c)
    return F.when(cell.isNotNull(), apply(cell, F.lit(float(number)))).otherwise(apply(c, F.lit(_plain(value))))


def _between(c: Column, dtype: T.DataType, value: Any) -> Column:
    if not isinstance(value, (list, tuple)) or len(value) < 2:
        return F.lit(False)
    low, high = value[0], value[1]
    if isinstance(dtype, T.StringType):
        bounds = [_number(low), _number(high)]
        as_strings = c.between(F.lit(_plain(low)), F.lit(_plain(high)))
        if None in bounds:
            return as_strings
        cell = coerced_number(c)
        return F.when(cell.isNotNull(), cell.between(F.lit(float(bounds[0])), F.lit(float(bounds[1])))).otherwise(as_strings)
    return _compares(c, dtype, low, "gte") & _compares(c, dtype, high, "lte")


def condition(df: DataFrame, key: str, op: str, value: Any = None) -> Column:
    """One filter as a predicate on ``df``.

    ``neq`` and ``not_in`` keep null cells; an empty ``in`` list keeps nothing, an empty ``not_in`` list everything.
    """
    c, dtype = F.col(f"`{key}`"), df.schema[key].dataType
    if op == "is_null" or (op == "eq" and value is None):
        return c.isNull()
    if op == "is_not_null" or (op == "neq" and value is None):
        return c.isNotNull()
    if op == "eq":
        return _equals(c, dtype, value)
    if op == "neq":
        return c.isNull() | ~_equals(c, dtype, value)
    if op in ("in", "not_in"):
        values = list(value) if isinstance(value, (list, tuple)) else []
        if is_numeric(dtype):
            numbers = [_number(v) for v in values if _is_written_number(v)]
            hit = c.isin(numbers) if numbers else F.lit(False)
        elif isinstance(dtype, T.StringType):
            hit = c.isin([_plain(v) for v in values]) if values else F.lit(False)
        else:
            hit = reduce(lambda a, b: a | b, [_equals(c, dtype, v) for v in values], F.lit(False))
        return hit if op == "in" else (c.isNull() | ~hit if values else F.lit(True))
    if op == "between":
        return _between(c, dtype, value)
    if op in ("gt", "gte", "lt", "lte"):
        return _compares(c, dtype, value, op)
    if op in ("contains", "starts_with", "ends_with"):
        cell, part = F.lower(as_text(c, dtype)), F.lit("" if value is None else _plain(value).lower())
        return {"contains": cell.contains(part), "starts_with": cell.startswith(part), "ends_with": cell.endswith(part)}[op]
    raise ValueError(f"unknown filter operator {op!r}")


def where_all(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """Rows that pass every filter."""
    for key, op, value in filters:
        df = df.where(condition(df, key, op, value))
    return df


def read_shorthand(columns: Iterable[str], key: str, entry: Any) -> Filter | None:
    """A filter from its short form, or None when the column is unknown or the value unusable.

    A scalar means ``eq``, None ``is_null``, a list ``in``; a mapping gives ``operator``/``value`` and may name its
    ``columnKey``. A ``filter_`` prefix on the key is dropped when only the bare name is a column.
    """
    columns = set(columns)
    if isinstance(entry, Mapping) and isinstance(entry.get("columnKey"), str):
        key = entry["columnKey"]
    elif key not in columns and key.startswith("filter_") and key[7:] in columns:
        key = key[7:]
    if key not in columns:
        return None
    op, value = "eq", entry
    if isinstance(entry, Mapping):
        if not isinstance(entry.get("operator"), str):
            return None
        op, value = entry["operator"], entry.get("value")
    elif entry is None:
        op = "is_null"
    elif isinstance(entry, (list, tuple)):
        op = "in"
    if op not in OPERATORS:
        return None
    scalars = (str, int, float, bool, dt.date, type(None))
    if isinstance(value, (list, tuple)):
        if not all(isinstance(v, (str, int, float)) and not isinstance(v, bool) for v in value):
            return None
        value = list(value)
    elif not isinstance(value, scalars):
        return None
    return key, op, value


def bound_filters(
    columns: Iterable[str],
    own: Iterable[Filter] = (),
    active: Mapping[str, Any] | Iterable[Filter] | None = None,
    bindings: Iterable[str] = (),
) -> list[Filter]:
    """A report's own filters plus the shared ones it is bound to, each once.

    Without bindings every shared filter applies; otherwise the key must be bound by its bare or ``filter_`` name.
    """
    columns, bindings = list(columns), set(bindings)
    found = list(own)
    if isinstance(active, Mapping):
        for key, entry in active.items():
            names = {key, f"filter_{key}"} | ({key[7:]} if key.startswith("filter_") else set())
            if bindings and not (bindings & names):
                continue
            parsed = read_shorthand(columns, key, entry)
            if parsed:
                found.append(parsed)
    elif active:
        found += [f for f in active if not bindings or {f[0], f"filter_{f[0]}"} & bindings]
    unique: list[Filter] = []
    for f in found:
        if f not in unique:
            unique.append(f)
    return unique


def control_filter(kind: str, key: str, value: Any) -> Filter | None:
    """The filter of a dashboard control; an untouched control gives none, an open range end its default."""
    if kind == "select":
        return None if value in (None, "") else (key, "eq", value)
    if kind == "multi-select":
        return (key, "in", list(value)) if value else None
    if kind == "search":
        return (key, "contains", value) if value else None
    if kind in ("date-range", "numeric-range"):
        low, high = value or (None, None)
        if low in (None, "") and high in (None, ""):
            return None
        ends = DATE_RANGE_ENDS if kind == "date-range" else NUMERIC_RANGE_ENDS
        return (key, "between", [ends[0] if low in (None, "") else low, ends[1] if high in (None, "") else high])
    raise ValueError(f"unknown control {kind!r}")
