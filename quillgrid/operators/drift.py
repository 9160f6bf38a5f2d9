"""Schema drift: incoming tables against expected schemas, with rename suggestions and a fingerprint.

Schemas are rows ``(expectation_id, ordinal, key, type)`` and ``(expectation_id, ordinal, key, original_name, type,
sample_values)``, so one job checks a whole catalogue of tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.numbers import fixed, is_numeric, parse_numeric
from ..functions.similarity import name_similarity
from ..functions.text import FORBIDDEN_KEYS, as_text, trimmed

NUMERIC = ["number", "currency", "percent"]
# Types that can stand in for an expected type, besides itself and the numeric ones for each other.
STANDS_IN = {
    "category": ["id", "boolean", "text"],
    "id": ["category", "text"],
    "boolean": ["number", "category"],
}
# Score adjustments and thresholds of rename suggestions and of the verdict.
SAME_TYPE, COERCIBLE_TYPE, OTHER_TYPE = 0.2, 0.05, -0.25
SUGGEST_FROM, COUNT_FROM, TRUST_FROM = 0.6, 0.7, 0.8
COERCED_CONFIDENCE, REMAP_WEIGHT = 0.85, 0.9


def coercible(expected: Column, actual: Column) -> Column:
    """Whether data of one type can serve where another is expected; anything can serve as text."""
    test = (expected == actual) | (expected == "text") | (expected.isin(NUMERIC) & actual.isin(NUMERIC))
    for kind, others in STANDS_IN.items():
        test = test | ((expected == kind) & actual.isin(others))
    return test


#: What a report field implies for the columns it names, by report type and field.
FIELD_TYPES = {
    "kpi": [("measure", "number")],
    "line": [("time", "date"), ("measures", "number")],
    "bar": [("dimension", "category"), ("measures", "number")],
    "donut": [("dimension", "category"), ("measure", "number")],
    "table": [("columns", "by name")],
    "pivot": [("rows", "category"), ("columns", "category"), ("measures", "number")],
}
#: Formats that say more than the field: which of them count for a report type.
FORMAT_TYPES = {("kpi", "measure"): ["currency", "percent"], ("table", "columns"): ["currency", "percent"], ("pivot", "measures"): ["currency"]}
CONTROL_TYPES = {"date-range": "date", "numeric-range": "number"}


def _type_by_name(key: str) -> str:
    name = key.lower()
    if re.search("(^id|_id|_code|_sku)$", name):
        return "id"
    return "date" if re.search("date|time", name) else "text"


def _type_by_format(fmt: Mapping[str, Any]) -> str | None:
    return "currency" if fmt.get("currency") else "percent" if fmt.get("suffix") == "%" else None


def _mentions(report: Mapping[str, Any]) -> Iterable[tuple[str, str]]:
    for field, implied in FIELD_TYPES[report["type"]]:
        named = report.get(field, [])
        for entry in [named] if isinstance(named, str) else named:
            key = entry if isinstance(entry, str) else entry[0]
            fmt = _type_by_format(report.get("formats", {}).get(key, {}))
            counts = fmt in FORMAT_TYPES.get((report["type"], field), [])
            yield key, fmt if counts else _type_by_name(key) if implied == "by name" else implied


def expected_columns(reports: Iterable[Mapping[str, Any]], controls: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """``(key, type)`` implied by dashboard controls ``(kind, key)`` and report definitions; the first mention wins."""
    mentions = [(key, CONTROL_TYPES.get(kind, "category")) for kind, key in controls]
    mentions += [m for r in reports for m in _mentions(r)]
    found: dict[str, str] = {}
    for key, kind in mentions:
        found.setdefault(key, kind)
    return list(found.items())


def schema_rows(profile: DataFrame, expectation_id: str) -> DataFrame:
    """A profile as actual-schema rows."""
    return profile.select(
        F.lit(expectation_id).alias("expectation_id"), "ordinal", F.col("column_key").alias("key"), "original_name", F.col("inferred_type").alias("type")
    )


def compare_schemas(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per column of either side: matched, mismatch (coercible or not), missing or added."""
    e = expected.select("expectation_id", "key", F.col("ordinal").alias("expected_ordinal"), F.col("type").alias("expected_type"))
    a = actual.select("expectation_id", "key", F.col("ordinal").alias("actual_ordinal"), "original_name", F.col("type").alias("actual_type"))
    both = e.join(a, ["expectation_id", "key"], "full_outer")
    fits = coercible(F.col("expected_type"), F.col("actual_type"))
    equal = F.col("expected_type") == F.col("actual_type")
    status = (
        F.when(F.col("actual_type").isNull(), "missing")
        .when(F.col("expected_type").isNull(), "added")
        .when(equal, "matched")
        .when(fits, "coercible")
        .otherwise("mismatch")
    )
    return both.select(
        "*",
        status.alias("status"),
        F.when(equal, F.lit(1.0)).when(fits & F.col("actual_type").isNotNull(), F.lit(COERCED_CONFIDENCE)).alias("confidence"),
    )


def scored_renames(comparison: DataFrame) -> DataFrame:
    """Every missing column against every added column of the same table, with its score.

    Pairs are formed inside one table's columns, which are few; tables never meet.
    """
    missing = comparison.where(F.col("status") == "missing").select(
        "expectation_id", F.col("key").alias("missing_key"), "expected_ordinal", "expected_type"
    )
    added = comparison.where(F.col("status") == "added").select(
        "expectation_id", F.col("key").alias("suggested_key"), "actual_ordinal", "original_name", "actual_type"
    )
    pairs = missing.join(added, "expectation_id")
    alike = F.greatest(
        name_similarity(F.col("missing_key"), F.col("suggested_key")), name_similarity(F.col("missing_key"), F.col("original_name"))
    )
    fit = (
        F.when(F.col("expected_type") == F.col("actual_type"), SAME_TYPE)
        .when(coercible(F.col("expected_type"), F.col("actual_type")), COERCIBLE_TYPE)
        .otherwise(OTHER_TYPE)
    )
    scored = pairs.withColumn("score", alike + fit)
    return scored.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), fixed(F.col("score"), 3)))).drop("score")


def _pick_renames(scores: pd.DataFrame) -> pd.DataFrame:
    used: set[str] = set()
    picked = []
    for _, options in scores.sort_values(["expected_ordinal", "actual_ordinal"], kind="stable").groupby("expected_ordinal", sort=True):
        free = options[~options["suggested_key"].isin(used)]
        if len(free):
            best = free.loc[free["confidence"].idxmax()]
            if best["confidence"] >= SUGGEST_FROM:
                used.add(best["suggested_key"])
                picked.append(best)
    return pd.DataFrame(picked, columns=scores.columns)


def suggest_renames(comparison: DataFrame) -> DataFrame:
    """Per missing column, in expected order, the best added column not yet taken, if it scores high enough.

    Each choice depends on the ones before it, so one table's scores, at most its columns squared, go to one task.
    """
    scores = scored_renames(comparison)
    return scores.groupBy("expectation_id").applyInPandas(_pick_renames, scores.schema).select(
        "expectation_id", "missing_key", "suggested_key", "expected_type", "actual_type", "confidence"
    )


def verdict(comparison: DataFrame, renames: DataFrame) -> DataFrame:
    """One row per expectation: counts, whether the change breaks reports, and an overall confidence."""
    status, sure = F.col("status"), F.col("confidence")
    state = comparison.groupBy("expectation_id").agg(
        F.count_if(F.col("expected_type").isNotNull()).alias("n_expected"),
        F.count_if(status.isin("matched", "coercible")).alias("n_matched"),
        F.count_if(status == "missing").alias("n_missing"),
        F.count_if(status == "added").alias("n_added"),
        F.count_if(status == "mismatch").alias("n_incompatible"),
        F.coalesce(F.sum(sure), F.lit(0.0)).alias("matched_score"),
    )
    renamed = renames.groupBy("expectation_id").agg(
        F.count_if(sure >= TRUST_FROM).alias("n_trusted"),
        F.sum(F.when(sure >= COUNT_FROM, sure * REMAP_WEIGHT)).alias("rename_score"),
    )
    both = state.join(renamed, "expectation_id", "left").na.fill(0, ["n_trusted", "rename_score"])
    score = (F.col("matched_score") + F.col("rename_score")) / F.greatest(F.lit(1), F.col("n_expected"))
    return both.select(
        "expectation_id",
        "n_expected",
        "n_matched",
        "n_missing",
        "n_added",
        ((F.col("n_missing") > F.col("n_trusted")) | (F.col("n_incompatible") > 0)).alias("breaking"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), fixed(score, 3))).alias("overall_confidence"),
    )


def _usable(mapping: Mapping[str, str]) -> dict[str, str]:
    """Renames without forbidden or blank names."""
    return {
        old: new
        for old, new in mapping.items()
        if old not in FORBIDDEN_KEYS and isinstance(new, str) and new not in FORBIDDEN_KEYS and new.strip()
    }


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """A new table under its expected names: ``mapping`` goes from expected to found names."""
    return df.withColumnsRenamed({new: old for old, new in _usable(mapping).items() if new in df.columns})


#: What a boolean may look like in text, in lower case.
_YES, _NO = ["true", "yes", "y", "1"], ["false", "no", "n", "0"]


def _as_type(c: Column, dtype: T.DataType, expected: str) -> Column | None:
    """A cell as its expected type, null where it does not convert; None where no cell of this type ever does."""
    text = as_text(c, dtype)
    if expected in NUMERIC:
        return parse_numeric(c) if isinstance(dtype, T.StringType) else c.cast("double") if is_numeric(dtype) or isinstance(dtype, T.BooleanType) else None
    if expected == "boolean":
        low = F.lower(trimmed(text))
        seen = F.when(low.isin(_YES), True).when(low.isin(_NO), False)
        return c if isinstance(dtype, T.BooleanType) else F.when(c == 1, True).when(c == 0, False) if is_numeric(dtype) else seen
    if expected == "date":
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("date")
        return parse_date(c) if isinstance(dtype, T.StringType) else None
    return text


def remap_table(
    df: DataFrame, mapping: Mapping[str, str], expected: Mapping[str, str], key: str | None = None, found: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """A new table under its expected names and types, and the cells that did not convert.

    ``mapping`` goes from expected to found names, ``expected`` from expected names to types. ``found`` gives the inferred types of columns, by
    expected name; a column whose type cannot serve for the expected one (``coercible``) stays as it is and all its cells are listed. Without it every
    column is tried. Blank cells are null and no failures. The second table has ``column_key``, ``expected_type``, ``row_key``
    (the text of the found column ``key``, else null) and ``value``; both come from one pass over the table each.
    """
    named = rename_columns(df, mapping)
    new = {found_name: name for name, found_name in _usable(mapping).items()}
    row_key = F.lit(None).cast("string") if key is None else as_text(F.col(f"`{new.get(key, key)}`"), named.schema[new.get(key, key)].dataType)
    columns, failures = [], []
    for f in named.schema.fields:
        cell, kind = F.col(f"`{f.name}`"), expected.get(f.name)
        serves = kind is None or found is None or f.name not in found or _serves(kind, found[f.name])
        made = cell if kind is None else _as_type(cell, f.dataType, kind) if serves else None
        columns.append((cell if made is None else made).alias(f.name))
        if kind is None:
            continue
        text = as_text(cell, f.dataType)
        failed = (trimmed(text) != "") & (F.lit(True) if made is None else made.isNull())
        failures.append(F.when(failed, F.struct(F.lit(f.name).alias("column_key"), F.lit(kind).alias("expected_type"), row_key.alias("row_key"), text.alias("value"))))
    listed = F.filter(F.array(*failures), lambda x: x.isNotNull()) if failures else F.array().cast("array<struct<column_key:string,expected_type:string,row_key:string,value:string>>")
    return named.select(*columns), named.select(F.inline(listed))


def _serves(expected: str, actual: str) -> bool:
    """``coercible`` for two types by name."""
    return expected == actual or expected == "text" or (expected in NUMERIC and actual in NUMERIC) or actual in STANDS_IN.get(expected, [])


def remap_reports(reports: Iterable[Mapping[str, Any]], mapping: Mapping[str, str]) -> list[dict[str, Any]]:
    """Report definitions with column names replaced wherever they are used."""
    new = _usable(mapping)

    def key(name: str) -> str:
        return new.get(name, name)

    out = []
    for r in reports:
        r = dict(r)
        for field in ("measure", "dimension", "time"):
            if field in r:
                r[field] = key(r[field])
        for field in ("columns", "rows", "bindings"):
            if field in r:
                r[field] = [key(k) for k in r[field]]
        if "measures" in r:
            r["measures"] = [key(m) if isinstance(m, str) else (key(m[0]), m[1]) for m in r["measures"]]
        if r["type"] == "table" and r.get("sort"):
            r["sort"] = (key(r["sort"][0]), r["sort"][1])
        if "filters" in r:
            r["filters"] = [(key(k), op, value) for k, op, value in r["filters"]]
        out.append(r)
    return out


def fingerprint(columns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """SHA-256 over the sorted ``key:type:required`` parts of a schema given as ``column_key, inferred_type, nullable``.

    Keys sort in dictionary order, where ``_`` comes before digits. A schema's columns are few, so listing them is safe.
    """
    # A collation key orders the parts; the text itself stays as it is.
    part = F.concat_ws(":", "column_key", "inferred_type", F.when(F.col("nullable"), "false").otherwise("true"))
    rows = F.array_sort(F.collect_list(F.struct(F.collate(F.col("column_key"), "UNICODE").alias("at"), part.alias("part"))))
    text = F.array_join(F.transform(rows, lambda r: r["part"]), "|")
    grouped = columns.groupBy(*by) if by else columns.groupBy()
    return grouped.agg(F.sha2(text, 256).alias("hash"), F.count(F.lit(1)).alias("column_count"))
