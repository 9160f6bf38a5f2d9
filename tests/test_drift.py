import hashlib

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import drift as D

EXPECTED = "expectation_id string, ordinal int, key string, type string"
ACTUAL = "expectation_id string, ordinal int, key string, original_name string, type string"


def compared(spark, expected, actual):
    e = spark.createDataFrame([(x, i, k, t) for x, cols in expected.items() for i, (k, t) in enumerate(cols)], EXPECTED)
    a = spark.createDataFrame([(x, i, k, k, t) for x, cols in actual.items() for i, (k, t) in enumerate(cols)], ACTUAL)
    return D.compare_schemas(e, a)


def test_statuses_and_verdict(spark):
    c = compared(
        spark,
        {"t1": [("id", "id"), ("amount", "currency"), ("emp_name", "text"), ("gone", "date")], "t2": [("a", "number")]},
        {"t1": [("id", "text"), ("amount", "number"), ("employee_name", "text")], "t2": [("a", "number")]},
    )
    status = {(r["expectation_id"], r["key"]): (r["status"], r["confidence"]) for r in c.collect()}
    assert status["t1", "id"] == ("coercible", 0.85) and status["t1", "amount"] == ("coercible", 0.85)
    assert status["t1", "gone"] == ("missing", None) and status["t1", "employee_name"] == ("added", None) and status["t2", "a"] == ("matched", 1.0)
    renames = D.suggest_renames(c)
    assert [(r["missing_key"], r["suggested_key"]) for r in renames.collect()] == [("emp_name", "employee_name")]
    verdicts = {r["expectation_id"]: (r["breaking"], r["overall_confidence"]) for r in D.verdict(c, renames).collect()}
    # emp_name: 0.4 * (1 - 5/13) + 0.5 = 0.746, + 0.2 for the type; (1.7 + 0.9 * 0.946) / 4.
    assert verdicts == {"t1": (True, 0.638), "t2": (False, 1.0)}


def test_each_added_column_is_suggested_once(spark):
    c = compared(spark, {"t": [("order_total", "number"), ("order_totals", "number")]}, {"t": [("order_total_", "number")]})
    assert [r["missing_key"] for r in D.suggest_renames(c).collect()] == ["order_total"]


@pytest.mark.parametrize(
    ("expected", "actual", "fits"),
    [("number", "percent", True), ("text", "date", True), ("category", "id", True), ("id", "number", False), ("boolean", "number", True), ("date", "text", False), ("category", "number", False)],
)
def test_coercible(spark, expected, actual, fits):
    assert spark.range(1).select(D.coercible(F.lit(expected), F.lit(actual))).first()[0] is fits


def test_expected_columns():
    reports = [
        {"type": "kpi", "measure": "rate", "formats": {"rate": {"suffix": "%"}}},
        {"type": "line", "time": "day", "measures": ["rate", "sales"]},
        {"type": "table", "columns": ["sku_code", "ship_date", "remark", "sales"]},
        {"type": "donut", "dimension": "remark", "measure": "n"},
    ]
    assert dict(D.expected_columns(reports, [("numeric-range", "n")])) == {
        "n": "number", "rate": "percent", "day": "date", "sales": "number", "sku_code": "id", "ship_date": "date", "remark": "text",
    }


def test_remap(spark):
    df = spark.createDataFrame([(1, 2)], "new_a int, b int")
    assert D.rename_columns(df, {"a": "new_a", "x": "nope", "c": " ", "constructor": "b"}).columns == ["a", "b"]
    report = {"type": "pivot", "rows": ["a"], "columns": ["c"], "measures": [("a", "sum")], "bindings": ["a"], "filters": [("a", "eq", 1)]}
    assert D.remap_reports([report], {"a": "z", "c": "__proto__"}) == [
        {"type": "pivot", "rows": ["z"], "columns": ["c"], "measures": [("z", "sum")], "bindings": ["z"], "filters": [("z", "eq", 1)]}
    ]
    assert D.remap_reports([report], {}) == [report]


def test_fingerprint_sorts_by_dictionary_order(spark):
    df = spark.createDataFrame([("ab", "text", True), ("a1", "id", False), ("a_b", "number", False)], "column_key string, inferred_type string, nullable boolean")
    text = "a_b:number:true|a1:id:true|ab:text:false"
    assert tuple(D.fingerprint(df).first()) == (hashlib.sha256(text.encode()).hexdigest(), 3)
    assert D.fingerprint(df.orderBy(F.desc("column_key")).repartition(3)).first() == D.fingerprint(df).first()


def test_remap_with_casts(spark):
    """Cell by cell: what converts, what does not, and what cannot serve at all."""
    rows = [("k1", "$1,200.50", "Yes", "2024-02-29", 3, "7"), ("k2", "(5)", "maybe", "31/12/2024", 0, "x"), ("k3", " ", None, "never", 1, ""), ("k4", "12%", "n", "", 2, "007"), (None, "abc", "1", "Jan 5, 2024", None, "8")]
    df = spark.createDataFrame(rows, "key string, amt string, ok string, day string, flag int, code string")
    mapping = {"amount": "amt", "paid": "ok", "due": "day", "urgent": "flag", "number": "code", "__proto__": "key"}
    kinds = {"amount": "currency", "paid": "boolean", "due": "date", "urgent": "boolean", "number": "id"}
    table, failed = D.remap_table(df, mapping, kinds, "key")
    assert table.columns == ["key", "amount", "paid", "due", "urgent", "number"]
    assert [(r["amount"], r["paid"], str(r["due"]), r["urgent"], r["number"]) for r in table.collect()] == [
        (1200.5, True, "2024-02-29", None, "7"), (-5.0, None, "2024-12-31", False, "x"), (None, None, "None", True, ""), (12.0, False, "None", None, "007"), (None, True, "2024-01-05", None, "8"),
    ]
    assert {tuple(r) for r in failed.collect()} == {("urgent", "boolean", "k1", "3"), ("paid", "boolean", "k2", "maybe"), ("due", "date", "k3", "never"), ("urgent", "boolean", "k4", "2"), ("amount", "currency", None, "abc")}
    table, failed = D.remap_table(df, mapping, {"due": "number", "urgent": "date", "amount": "text"}, found={"due": "date", "amount": "currency"})
    assert dict(table.dtypes)["due"] == "string" and dict(table.dtypes)["urgent"] == "int" and failed.groupBy("column_key").count().count() == 2
    assert failed.where("column_key = 'urgent'").count() == 4 and failed.where("column_key = 'due'").count() == 4
    same, none = D.remap_table(df, {}, {})
    assert same.collect() == df.collect() and none.collect() == []


def test_serves_is_coercible(spark):
    kinds = ["number", "currency", "percent", "text", "category", "id", "boolean", "date"]
    pairs = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    for r in pairs.select("a", "b", D.coercible(F.col("a"), F.col("b")).alias("c")).collect():
        assert D._serves(r["a"], r["b"]) == r["c"]
