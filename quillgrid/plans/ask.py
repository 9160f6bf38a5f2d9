"""Answers to plain questions by rules, without a model: top N, average, total, count, or a list of records."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, Row

from ..functions.vocabulary import QUESTION_TIME, REPORT_DURATION
from ..operators.profile import describe_columns
from .reports import REPORTS

# Words of each kind of question and how much an answer shows.
TOP_WORDS, AVERAGE_WORDS, TOTAL_WORDS, COUNT_WORDS = ["top", "best", "highest"], ["average", "avg", "mean"], ["total", "sum"], ["count", "how many"]
TOP_DEFAULT, TOP_MOST, GROUP_LIMIT, RECORD_LIMIT, RECORD_COLUMNS = 5, 100, 20, 50, 6


def _temporal(p: Row) -> bool:
    name = f"{p['original_name'] or ''} {p['column_key']}".lower()
    return any(w in name for w in QUESTION_TIME) and not any(w in name for w in REPORT_DURATION)


def _mentioned(p: Row, question: str) -> bool:
    key, original = p["column_key"].lower(), (p["original_name"] or "").lower()
    return key.replace("_", " ") in question or (len(original) > 2 and original in question) or (len(key) > 2 and key in question)


def read_question(question: str, profile: list[Row]) -> dict[str, Any]:
    """The report definition that answers a question. Columns named in it win over the first of the table."""
    q = question.lower()
    columns = [p["column_key"] for p in profile]
    measures = [
        p["column_key"] for p in profile
        if (p["semantic_role"] == "measure" or p["inferred_type"] in ("number", "currency"))
        and p["semantic_role"] != "time" and p["inferred_type"] != "date" and not _temporal(p)
    ]
    dimensions = [
        p["column_key"] for p in profile
        if p["semantic_role"] in ("dimension", "time") or p["inferred_type"] in ("category", "text", "date") or _temporal(p)
    ]
    named = [p["column_key"] for p in profile if _mentioned(p, q)]
    measure = next((c for c in named if c in measures), measures[0] if measures else None)
    named_dimension = next((c for c in named if c in dimensions), None)
    others = [*(d for d in dimensions if d != measure), *dimensions, *(c for c in columns if c != measure), *columns]
    dimension = named_dimension or next(iter(others), None)

    def says(words: list[str]) -> bool:
        return any(w in q for w in words)

    def grouped(asked: bool) -> bool:
        return bool(dimension) and dimension != measure and (asked or named_dimension is not None)

    if says(TOP_WORDS) and measure and dimension and measure != dimension:
        number = re.search(r"(?:top|first)\s+(\d+)", q)
        limit = min(TOP_MOST, max(1, int(number[1]))) if number else TOP_DEFAULT
        return {"type": "bar", "dimension": dimension, "measures": [measure], "aggregation": "sum", "limit": limit}
    for words, aggregation, by in (
        (AVERAGE_WORDS, "avg", bool(re.search(r"\b(by|per)\b", q))),
        (TOTAL_WORDS, "sum", "by" in q or "per" in q),
    ):
        if says(words) and measure:
            if grouped(by):
                return {"type": "bar", "dimension": dimension, "measures": [measure], "aggregation": aggregation, "limit": GROUP_LIMIT}
            return {"type": "kpi", "measure": measure, "aggregation": aggregation}
    if says(COUNT_WORDS) and dimension:
        return {"type": "bar", "dimension": dimension, "measures": [dimension], "aggregation": "count", "limit": GROUP_LIMIT}
    return {"type": "table", "columns": columns[:RECORD_COLUMNS], "limit": RECORD_LIMIT}


def ask(df: DataFrame, question: str, profile: list[Row] | None = None) -> DataFrame:
    """The answer to a question as a DataFrame. ``profile`` spares the look at the table's columns."""
    if profile is None:
        profile = describe_columns(df).orderBy("ordinal").collect()
    report = read_question(question, profile)
    return REPORTS[report["type"]](df, report)
