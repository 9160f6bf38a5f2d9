"""Dashboard reports as functions ``DataFrame -> DataFrame``, and a runner over report definitions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import comparison
from ..functions.numbers import fixed, is_numeric
from ..operators.aggregates import Measure, aggregate, order_by, page_of, text_of, aggregate_of
from ..operators.filters import bound_filters, where_all

# Default lengths of ranked reports.
BAR_LIMIT = 20
DONUT_SLICES = 10
MISSING_LABEL = "—"

GRANULARITIES = ["day", "week", "month", "quarter", "year"]


def kpi(df: DataFrame, measure: str, aggregation: str = "sum", previous: float | None = None, target: float | None = None, change: str = "percent") -> DataFrame:
    """One number, named after its measure, with its change from a previous or target value when one is given."""
    out = aggregate(df, [], [(measure, aggregation, measure)])
    if previous is None and target is None:
        return out
    return out.select("*", *[c.alias(n) for n, c in comparison(F.col(f"`{measure}`"), previous, target, change).items()])


def trend(df: DataFrame, time: str, measures: Iterable[str], aggregation: str = "sum", granularity: str | None = None) -> DataFrame:
    """Measures by time, ascending. Times are grouped as they are unless a granularity is given."""
    measures = list(measures)
    if granularity is not None:
        if granularity not in GRANULARITIES:
            raise ValueError(f"granularity is one of {GRANULARITIES}")
        df = df.withColumn(time, F.date_trunc(granularity, F.col(f"`{time}`").cast("timestamp")))
    out = aggregate(df, [time], [(m, aggregation, m) for m in measures])
    return order_by(out, [(time, "asc")])


def bars(df: DataFrame, dimension: str, measures: Iterable[str], aggregation: str = "sum", sort: tuple[str, str] = ("value", "desc"), limit: int | None = BAR_LIMIT) -> DataFrame:
    """A ranking of one dimension by value or by label; equal values rank by label. ``limit=None`` keeps all."""
    measures = list(measures)
    # A dimension counted by itself would overwrite its label; it gets its own name instead.
    out = aggregate(df, [dimension], [(m, aggregation, "count_records" if m == dimension else m) for m in measures])
    first = measures[0] if measures[0] != dimension else "count_records"
    by, direction = sort
    keys = [(first, direction)] if by == "value" else [(dimension, direction)]
    return page_of(order_by(out, keys, ties=[dimension] if by == "value" else []), limit)


def donut(df: DataFrame, dimension: str, measure: str, aggregation: str = "sum", slices: int = DONUT_SLICES) -> DataFrame:
    """The largest slices of one dimension with their share of what is shown."""
    top = bars(df, dimension, [measure], aggregation, limit=slices)
    value = F.col(top.columns[1]).cast("double")
    # The window without a key runs after the limit, over at most ``slices`` rows.
    total = F.sum(value).over(Window.partitionBy())
    return top.withColumn("share", F.when(total > 0, fixed(value / total * 100, 1)))


def record_table(df: DataFrame, columns: Iterable[str], sort: tuple[str, str] | None = None, search: str | None = None, limit: int | None = None, ties: Iterable[str] = ()) -> DataFrame:
    """Chosen columns, optionally searched and sorted; all rows unless the caller names a limit."""
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    if search and search.strip():
        out = search_table(out, search)
    if sort or ties:
        out = order_by(out, [sort] if sort else [], ties=ties)
    return page_of(out, limit)


def search_table(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column contains the text, ignoring case."""
    wanted = F.lit(text.strip().lower())
    hits = [F.coalesce(F.lower(text_of(df, c)).contains(wanted), F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def page(df: DataFrame, number: int, size: int = 10, keys: Iterable[tuple[str, str]] = (), ties: Iterable[str] = (), total: int | None = None) -> DataFrame:
    """One page of an ordered table. A number past the end gives the last page.

    Only a page past the first needs the row count, which the caller may pass in as ``total``.
    """
    number = max(1, number)
    if number > 1:
        total = df.count() if total is None else total
        number = min(number, max(1, -(-total // size)))
    return page_of(order_by(df, keys, ties), size, (number - 1) * size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("bigint").alias("total_pages"))


def _named(measures: Iterable[tuple[str, str]]) -> list[Measure]:
    """Measures with their names; a repeated one is named ``measure_function``."""
    named: list[Measure] = []
    for key, function in measures:
        taken = {alias for _, _, alias in named}
        named.append((key, function, f"{key}_{function}" if key in taken else key))
    return named


def pivot_long(df: DataFrame, rows: Iterable[str], columns: Iterable[str], measures: Iterable[tuple[str, str]], sort: bool = True) -> DataFrame:
    """One row per combination of row and column dimensions; a repeated measure is named ``measure_function``."""
    rows, columns = list(rows), list(columns)
    out = aggregate(df, [*rows, *columns], _named(measures))
    return order_by(out, [(r, "asc") for r in rows]) if sort else out


def pivot_subtotals(df: DataFrame, rows: Iterable[str], columns: Iterable[str], measures: Iterable[tuple[str, str]]) -> DataFrame:
    """A pivot of any number of row and column dimensions with a subtotal for every leading part of both.

    ``row_level`` and ``column_level`` count the dimensions that a row keeps; the others are null there, as are missing values at levels
    that keep them. Every measure comes twice: from the data of its level, and as ``<name>_cells``, the sum of the finest
    cells, which is what a reader adds up on screen and differs for averages and distinct counts. All levels are aggregated in
    one pass over the data, and combined before the shuffle.
    """
    rows, columns, named = list(rows), list(columns), _named(measures)
    dims = [*rows, *columns]
    levels = [[F.col(f"`{d}`") for d in [*rows[:i], *columns[:j]]] for i in range(len(rows) + 1) for j in range(len(columns) + 1)]

    def kept(names: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [1 - F.grouping(f"`{d}`").cast("int") for d in names], F.lit(0))

    def by_level(frame: DataFrame, aggs: list[Column]) -> DataFrame:
        if not dims:
            return frame.agg(*aggs).select(F.lit(0).alias("row_level"), F.lit(0).alias("column_level"), "*")
        return frame.groupingSets(levels, *[F.col(f"`{d}`") for d in dims]).agg(kept(rows).alias("row_level"), kept(columns).alias("column_level"), *aggs)

    data = by_level(df, [aggregate_of(df, key, function).alias(alias) for key, function, alias in named])
    cells = aggregate(df, dims, named)
    sums = by_level(cells, [F.sum(F.col(f"`{alias}`")).alias(f"{alias}_cells") for *_, alias in named])
    keys = [*dims, "row_level", "column_level"]
    same = reduce(lambda a, b: a & b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    both = data.alias("a").join(sums.alias("b"), same)
    return both.select(*[F.col(f"a.`{k}`") for k in keys], *[F.col(f"`{alias}{more}`") for *_, alias in named for more in ("", "_cells")])


def pivot_cells(df: DataFrame, row: str, column: str | None, measure: tuple[str, str]) -> DataFrame:
    """Labelled cells ``(row_label, col_label, value)`` of the matrix; missing labels show a dash."""
    key, function = measure
    long = pivot_long(df, [row], [column] if column else [], [measure], sort=False)

    def label(name: str):
        return F.coalesce(text_of(long, name), F.lit(MISSING_LABEL))

    value = F.coalesce(F.col(f"`{key}`").cast("double"), F.lit(0.0)) if not is_numeric(long.schema[key].dataType) else F.coalesce(F.col(f"`{key}`"), F.lit(0).cast(long.schema[key].dataType))
    cells = long.select(label(row).alias("row_label"), (label(column) if column else F.lit("Value")).alias("col_label"), value.alias("value"))
    return cells.groupBy("row_label", "col_label").agg(F.sum("value").alias("value"))


def pivot_matrix(df: DataFrame, row: str, column: str, measure: tuple[str, str], values: list[str]) -> DataFrame:
    """The matrix of one row dimension and the listed labels of a column dimension, absent cells 0.

    Labels the caller does not list are in ``pivot_cells`` and ``pivot_long``, which hold every cell.
    """
    cells = pivot_cells(df, row, column, measure)
    wide = cells.groupBy(F.col("row_label").alias(row)).pivot("col_label", values).agg(F.sum("value"))
    return wide.na.fill(0, subset=values).orderBy(row)


def pivot_totals(df: DataFrame, row: str, column: str | None, measure: tuple[str, str]) -> DataFrame:
    """Cells with row, column and grand totals. Totals add up cells, also when a cell is an average."""
    cells = pivot_cells(df, row, column, measure)
    cube = cells.cube("row_label", "col_label").agg(F.sum("value").alias("value"), F.grouping_id().alias("level"))
    kinds = {0: "cell", 1: "row_total", 2: "column_total", 3: "grand_total"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("level").cast("int"))
    return cube.select("row_label", "col_label", "value", kind.alias("kind"))


REPORTS = {
    "kpi": lambda df, r: kpi(df, r["measure"], r.get("aggregation", "sum"), **r.get("comparison", {})),
    "line": lambda df, r: trend(df, r["time"], r["measures"], r.get("aggregation", "sum"), r.get("granularity")),
    "bar": lambda df, r: bars(df, r["dimension"], r["measures"], r.get("aggregation", "sum"), r.get("sort", ("value", "desc")), r.get("limit", BAR_LIMIT)),
    "donut": lambda df, r: donut(df, r["dimension"], r["measure"], r.get("aggregation", "sum"), r.get("slices", DONUT_SLICES)),
    "table": lambda df, r: record_table(df, r["columns"], r.get("sort"), r.get("search"), r.get("limit")),
    "pivot": lambda df, r: pivot_long(df, r["rows"], r.get("columns", []), r["measures"]),
}


def run_reports(df: DataFrame, reports: Iterable[Mapping[str, Any]], active: Mapping[str, Any] | None = None) -> dict[str, DataFrame | Exception]:
    """Every report definition as a DataFrame, keyed by its ``id``.

    A definition Spark rejects yields its exception in place of a frame, and the others still run. Frames are lazy and
    share the scan's pushed filters; nothing is cached, since the filtered table may be of any size.
    """
    out: dict[str, DataFrame | Exception] = {}
    for r in reports:
        try:
            kept = where_all(df, bound_filters(df.columns, r.get("filters", ()), active, r.get("bindings", ())))
            out[r["id"]] = REPORTS[r["type"]](kept, r)
        except (PySparkException, KeyError, ValueError, TypeError) as problem:
            out[r["id"]] = problem
    return out
