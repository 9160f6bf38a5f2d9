"""A default set of reports chosen from a profile.

Choosing reads the profile's rows, at most one per column, on the driver; every chosen report is a Spark aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row

from ..functions.vocabulary import REPORT_DURATION, REPORT_TIME
from ..operators.profile import profile_table
from .reports import run_reports

# How much a default report shows.
KPI_LIMIT, FILTER_DIMENSIONS, FILTER_OPTIONS = 4, 3, 20
DONUT_DISTINCT = (2, 6)
BAR_FULL, BAR_BESIDE = 20, 15
TABLE_EACH, TABLE_COLUMNS = 4, 8


def _name(p: Row) -> str:
    return f"{p['original_name'] or ''} {p['column_key']}".lower()


def report_measures(profile: list[Row]) -> list[str]:
    """Measure columns whose names do not speak of a time, unless of a duration."""
    out = []
    for p in profile:
        name = _name(p)
        temporal = any(w in name for w in REPORT_TIME) and not any(w in name for w in REPORT_DURATION)
        if p["semantic_role"] == "measure" and p["inferred_type"] != "date" and not temporal:
            out.append(p["column_key"])
    return out


def _key_candidate(profile: list[Row]) -> str | None:
    for p in profile:
        key = p["column_key"]
        unique = p["null_count"] == 0 and p["distinct_count"] == p["total_count"] > 0
        named = key == "id" or key.endswith(("_id", "_code", "_sku"))
        if unique and (named or p["semantic_role"] == "identifier" or p["inferred_type"] == "id"):
            return key
    return None


def default_filters(profile: list[Row]) -> list[dict[str, Any]]:
    """A date range for the time column and a choice list for each of the first dimensions."""
    out = []
    time = next((p["column_key"] for p in profile if p["semantic_role"] == "time"), None)
    if time:
        out.append({"id": f"filter_{time}", "column": time, "kind": "date-range"})
    for p in [p for p in profile if p["semantic_role"] == "dimension"][:FILTER_DIMENSIONS]:
        options = [v["value"] for v in (p["top_values"] or []) if v["value"] != ""][:FILTER_OPTIONS]
        out.append({"id": f"filter_{p['column_key']}", "column": p["column_key"], "kind": "select", "options": options or None})
    return out


def choose_reports(profile: list[Row], granularity: str | None = None) -> list[dict[str, Any]]:
    """Report definitions for a profiled table.

    ``granularity`` groups the trend's times (for example by ``month``); None keeps them as they are.
    """
    by_key = {p["column_key"]: p for p in profile}
    measures = report_measures(profile)
    dimensions = [p["column_key"] for p in profile if p["semantic_role"] == "dimension"]
    time = next((p["column_key"] for p in profile if p["semantic_role"] == "time"), None)
    key = _key_candidate(profile)
    any_column = key or profile[0]["column_key"]
    reports: list[dict[str, Any]] = []

    for m in measures[:KPI_LIMIT]:
        kind = by_key[m]["inferred_type"]
        formats = {"currency": {"currency": by_key[m]["currency_code"] or "USD"}, "percent": {"suffix": "%", "scale": 100, "precision": 1}}
        reports.append(
            {"id": f"kpi_{m}", "type": "kpi", "measure": m, "aggregation": "avg" if kind == "percent" else "sum", "formats": {m: formats.get(kind, {})}}
        )
    if not measures:
        reports.append({"id": "kpi_total_records", "type": "kpi", "measure": any_column, "aggregation": "count"})

    trend = time is not None and bool(measures)
    if trend:
        reports.append({"id": f"line_trend_{measures[0]}", "type": "line", "time": time, "measures": measures[:1], "granularity": granularity})
    few = next((p["column_key"] for p in profile if p["semantic_role"] == "dimension" and DONUT_DISTINCT[0] <= p["distinct_count"] <= DONUT_DISTINCT[1]), None)
    bar_drawn = False
    if few:
        shown = (measures[1:2] or measures[:1] if trend else measures[:1]) or [any_column]
        reports.append({"id": f"donut_breakdown_{few}", "type": "donut", "dimension": few, "measure": shown[0], "aggregation": "sum" if measures else "count"})
        other = next((d for d in dimensions if d != few), None)
        if not trend and other and measures:
            reports.append({"id": f"bar_breakdown_{other}", "type": "bar", "dimension": other, "measures": measures[:1], "limit": BAR_BESIDE})
            bar_drawn = True
    if not bar_drawn and dimensions and measures:
        reports.append({"id": f"bar_breakdown_{dimensions[0]}", "type": "bar", "dimension": dimensions[0], "measures": measures[:1], "limit": BAR_FULL})
    if len(dimensions) >= 2 and measures:
        reports.append({"id": "pivot_matrix", "type": "pivot", "rows": dimensions[:1], "columns": dimensions[1:2], "measures": [(measures[0], "sum")]})

    columns = list(dict.fromkeys([*([key] if key else []), *dimensions[:TABLE_EACH], *measures[:TABLE_EACH]]))
    for p in profile:
        if len(columns) >= TABLE_COLUMNS:
            break
        if p["column_key"] not in columns:
            columns.append(p["column_key"])
    reports.append({"id": "table_records", "type": "table", "columns": columns})
    bindings = [f["id"] for f in default_filters(profile)]
    return [{**r, "bindings": bindings} for r in reports]


def auto_report(
    df: DataFrame, order: Column | None = None, active: Mapping[str, Any] | None = None, granularity: str | None = None, profile: list[Row] | None = None
) -> dict[str, DataFrame | Exception]:
    """Profile a table, choose its reports and run them. ``profile`` spares the profiling of a known table."""
    if profile is None:
        profile = profile_table(df, order, parts=["top_values"]).collect()
    return run_reports(df, choose_reports(profile, granularity), active)
