"""Grouping, aggregates, order and paging of one table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import cell_number, is_numeric
from ..functions.text import as_text, plain_number

FUNCTIONS = ["sum", "avg", "count", "min", "max", "distinctCount"]

Measure = tuple[str, str, str]  # column, function, alias


def aggregate_of(df: DataFrame, key: str, function: str) -> Column:
    """One aggregate over a column.

    Text and boolean cells are read as numbers where they are numbers. The least and greatest of a text column is
    numeric as soon as one cell is a number, and is given back as text.
    """
    c, dtype = F.col(f"`{key}`"), df.schema[key].dataType
    if function == "count":
        return F.count(c)
    if function == "distinctCount":
        return F.count_distinct(c)
    if function in ("sum", "avg"):
        values = c if is_numeric(dtype) else cell_number(c, dtype)
        return (F.sum if function == "sum" else F.avg)(values)
    if function in ("min", "max"):
        pick = F.min if function == "min" else F.max
        if isinstance(dtype, T.BooleanType):
            return pick(c.cast("int"))
        if isinstance(dtype, T.StringType):
            return F.coalesce(plain_number(pick(cell_number(c, dtype))), pick(c))
        return pick(c)
    raise ValueError(f"unknown aggregate {function!r}")


def aggregate(df: DataFrame, dimensions: Iterable[str] = (), measures: Iterable[Measure] = ()) -> DataFrame:
    """Group by the dimensions; no dimensions give one row, no measures the distinct groups."""
    dimensions, measures = list(dimensions), list(measures)
    if not measures:
        return df.select(*dimensions).distinct()
    aggs = [aggregate_of(df, key, function).alias(alias) for key, function, alias in measures]
    return df.groupBy(*dimensions).agg(*aggs) if dimensions else df.agg(*aggs)


def orders_of(df: DataFrame, keys: Iterable[tuple[str, str]], ties: Iterable[str] = (), locale: bool = True) -> list[Column]:
    """Sort expressions of ``(column, "asc" | "desc")`` pairs, nulls last both ways.

    Text sorts numbers in text first and by value, then the rest in dictionary order (``locale=False`` for byte order).
    ``ties`` are extra ascending keys that make the order total.
    """
    orders: list[Column] = []
    for key, direction in [*keys, *((t, "asc") for t in ties)]:
        c, dtype = F.col(f"`{key}`"), df.schema[key].dataType
        parts = [c]
        if isinstance(dtype, T.StringType) and locale:
            parts = [cell_number(c, dtype), F.collate(c, "UNICODE")]
        orders += [p.desc_nulls_last() if direction == "desc" else p.asc_nulls_last() for p in parts]
    return orders


def order_by(df: DataFrame, keys: Iterable[tuple[str, str]], ties: Iterable[str] = (), locale: bool = True) -> DataFrame:
    """The frame sorted by ``orders_of``."""
    return df.orderBy(*orders_of(df, keys, ties, locale))


def page_of(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an ordered frame; Spark plans order + limit as a top-k."""
    if limit is not None and limit < 1:
        raise ValueError("limit is at least 1")
    if offset < 0:
        raise ValueError("offset is not negative")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def text_of(df: DataFrame, key: str) -> Column:
    return as_text(F.col(f"`{key}`"), df.schema[key].dataType)
