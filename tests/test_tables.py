import random
import re

import pytest
from pyspark.sql import functions as F

from quillgrid.operators.aggregates import aggregate, order_by, page_of
from quillgrid.operators.filters import bound_filters, condition, control_filter, read_shorthand, where_all
from quillgrid.plans import reports as R
from quillgrid.plans.paging import index_pages

SALES = [
    ("East", "Tech", 100.0, 20.0, 2), ("East", "Office", 200.0, 40.0, 5), ("West", "Tech", 300.0, -10.0, 3),
    ("West", "Office", 400.0, 80.0, 10), ("North", "Furniture", 150.0, 15.0, 1), ("South", None, 50.0, None, 1),
]


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, "region string, category string, sales double, profit double, units int")


def values(df, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_aggregates(sales):
    measures = [("sales", "sum", "s"), ("sales", "avg", "a"), ("sales", "count", "n"), ("profit", "min", "lo"), ("profit", "max", "hi"), ("category", "distinctCount", "d")]
    assert tuple(aggregate(sales, [], measures).first()) == (1200.0, 200.0, 6, -10.0, 80.0, 3)


def test_global_aggregate_of_nothing_is_one_row(sales):
    out = aggregate(sales.where("false"), [], [("sales", "sum", "s"), ("sales", "count", "n")]).collect()
    assert [tuple(r) for r in out] == [(None, 0)]


def test_group_and_rank(sales):
    assert values(R.bars(sales, "region", ["sales"]), "region", "sales") == [("West", 700.0), ("East", 300.0), ("North", 150.0), ("South", 50.0)]
    both = {(r[0], r[1]): r[2] for r in aggregate(sales, ["region", "category"], [("units", "sum", "u")]).collect()}
    assert both["East", "Office"] == 5 and both["West", "Tech"] == 3 and both["South", None] == 1


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        ([("region", "eq", "East"), ("sales", "gt", 150)], [200.0]),
        ([("sales", "between", [100, 250])], [100.0, 150.0, 200.0]),
        ([("region", "in", ["East", "West"]), ("category", "not_in", ["Tech"])], [200.0, 400.0]),
        ([("category", "contains", "rn")], [150.0]),
        ([("category", "is_null", None)], [50.0]),
        ([("category", "neq", "Tech")], [50.0, 150.0, 200.0, 400.0]),
        ([("category", "neq", None)], [100.0, 150.0, 200.0, 300.0, 400.0]),
        ([("category", "eq", None)], [50.0]),
        ([("category", "not_in", [])], [50.0, 100.0, 150.0, 200.0, 300.0, 400.0]),
        ([("category", "in", [])], []),
        ([("sales", "between", [100])], []),
        ([("sales", "eq", "100")], [100.0]),
        ([("sales", "eq", "100.0")], []),
        ([("region", "starts_with", "we")], [300.0, 400.0]),
        ([("region", "ends_with", "TH")], [50.0, 150.0]),
        ([("sales", "contains", "50")], [50.0, 150.0]),
        ([("region", "gte", "South")], [50.0, 300.0, 400.0]),
        ([("units", "in", [1, "5", "x"])], [50.0, 150.0, 200.0]),
    ],
)
def test_filters(sales, filters, expected):
    assert sorted(values(where_all(sales, filters), "sales")) == expected


def test_untyped_text_compares_as_numbers_when_it_is(spark):
    df = spark.createDataFrame([("9",), ("10",), ("0x10",), ("n/a",), ("",), (None,)], "v string")
    assert values(df.where(condition(df, "v", "gt", 9.5)), "v") == ["10", "0x10", "n/a"]
    assert values(df.where(condition(df, "v", "lte", "9")), "v") == ["9", ""]
    assert tuple(aggregate(df, [], [("v", "sum", "s"), ("v", "min", "lo"), ("v", "max", "hi")]).first()) == (35.0, "0", "16")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) as d", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = where_all(df, [("d", "gte", 3), ("s", "eq", "4"), ("id", "in", [4, 5])]).select("d")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,3.0)" in plan and "EqualTo(s,4)" in plan and "In(id, [4,5])" in plan and "ReadSchema: struct<id:bigint,d:double,s:string>" in plan


def test_shorthand_and_bindings():
    columns = ["region", "sales"]
    assert read_shorthand(columns, "region", "East") == ("region", "eq", "East")
    assert read_shorthand(columns, "filter_region", ["a", "b"]) == ("region", "in", ["a", "b"])
    assert read_shorthand(columns, "region", None) == ("region", "is_null", None)
    assert read_shorthand(columns, "x", {"columnKey": "sales", "operator": "gt", "value": 5}) == ("sales", "gt", 5)
    assert read_shorthand(columns, "nope", 1) is None and read_shorthand(columns, "region", {"operator": "like", "value": 1}) is None
    active = {"filter_region": "East", "sales": {"operator": "gt", "value": 1}}
    assert bound_filters(columns, [], active, ["region"]) == [("region", "eq", "East")]
    assert bound_filters(columns, [("region", "eq", "East")], active) == [("region", "eq", "East"), ("sales", "gt", 1)]
    assert bound_filters(columns, [], [("sales", "gt", 1)], ["filter_sales"]) == [("sales", "gt", 1)]


def test_controls():
    assert control_filter("date-range", "d", ("", "2024-01-01")) == ("d", "between", ["1970-01-01", "2024-01-01"])
    assert control_filter("numeric-range", "n", (5, None)) == ("n", "between", [5, 1e12])
    assert control_filter("select", "a", "") is None and control_filter("multi-select", "a", []) is None
    assert control_filter("search", "a", "x") == ("a", "contains", "x")


def test_order_nulls_last_and_paging(sales, spark):
    assert values(order_by(sales, [("profit", "asc")]), "profit") == [-10.0, 15.0, 20.0, 40.0, 80.0, None]
    assert values(order_by(sales, [("profit", "desc")]), "profit") == [80.0, 40.0, 20.0, 15.0, -10.0, None]
    assert values(page_of(order_by(sales, [("sales", "asc")]), 2, 2), "sales") == [150.0, 200.0]
    words = spark.createDataFrame([("b",), ("B",), ("_z",), ("a",), ("10",), ("9",), (None,)], "w string")
    assert values(order_by(words, [("w", "asc")]), "w") == ["9", "10", "_z", "a", "b", "B", None]
    with pytest.raises(ValueError):
        page_of(sales, 0)


def test_reports(sales):
    top = R.donut(sales, "region", "sales", slices=2).collect()
    assert [(r["region"], r["share"]) for r in top] == [("West", 70.0), ("East", 30.0)]
    assert R.kpi(sales, "sales", previous=1000.0).first().asDict() == {"sales": 1200.0, "diff": 200.0, "pct_change": 20.0, "direction": "positive", "change_text": "+20.0%"}
    counted = R.bars(sales, "region", ["region"], "count").collect()
    assert [tuple(r) for r in counted] == [("East", 2), ("West", 2), ("North", 1), ("South", 1)]
    assert values(R.search_table(sales, "OFF"), "sales") == [200.0, 400.0]
    assert values(R.page(sales, 99, 4, [("sales", "asc")]), "sales") == [300.0, 400.0]
    assert R.page_count(sales.where("false")).first()[0] == 1


def test_pivots(sales):
    long = R.pivot_long(sales, ["region"], ["category"], [("sales", "sum"), ("sales", "avg")])
    assert long.columns == ["region", "category", "sales", "sales_avg"]
    wide = {r["region"]: r.asDict() for r in R.pivot_matrix(sales, "region", "category", ("sales", "sum"), [r[0] for r in R.pivot_cells(sales, "region", "category", ("sales", "sum")).select("col_label").distinct().collect()]).collect()}
    assert wide["East"]["Tech"] == 100.0 and wide["South"]["—"] == 50.0 and wide["South"]["Tech"] == 0.0
    totals = {(r["row_label"], r["col_label"]): r["value"] for r in R.pivot_totals(sales.fillna({"category": "Other"}), "region", "category", ("sales", "avg")).collect()}
    assert totals["West", None] == 700.0 and totals[None, "Tech"] == 400.0 and totals[None, None] == 1200.0


def test_report_runner_survives_a_bad_report(sales):
    reports = [{"id": "good", "type": "kpi", "measure": "sales"}, {"id": "bad", "type": "kpi", "measure": "none"}, {"id": "odd", "type": "gauge"}]
    out = R.run_reports(sales, reports, {"region": "East"})
    assert out["good"].first()[0] == 300.0 and isinstance(out["bad"], Exception) and isinstance(out["odd"], Exception)


def test_trend_granularity(spark):
    df = spark.createDataFrame([("2024-01-05", 1), ("2024-01-20", 2), ("2024-02-01", 4)], "d string, v int").withColumn("d", F.to_date("d"))
    assert [r["v"] for r in R.trend(df, "d", ["v"], granularity="month").collect()] == [3, 4]
    assert [r["v"] for r in R.trend(df, "d", ["v"]).collect()] == [1, 2, 4]


def test_all_rows_columns_and_digits(spark, sales):
    """Nothing is cut that the caller did not ask to cut."""
    many = spark.range(60_000).withColumn("v", F.col("id") % 50)
    assert R.record_table(many, ["id"]).count() == 60_000
    assert R.bars(many, "id", ["v"], limit=None).count() == 60_000
    both = R.bars(sales, "region", ["region", "sales"], "count")
    assert both.columns == ["region", "count_records", "sales"]
    ids = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "id bigint")
    for op, value, n in (("eq", "9007199254740993", 1), ("in", ["9007199254740993"], 1), ("gt", "9007199254740992", 1)):
        assert where_all(ids, [("id", op, value)]).count() == n


@pytest.mark.parametrize("ranges", [1, 7])
def test_pages_of_an_index(spark, ranges):
    """Every page is that of the whole sorted table, nulls and ties included, and is read from few ranges."""
    rng = random.Random(ranges)
    rows = [(i, rng.choice([None, "b", "a", "10", "9", ""]), None if rng.random() < 0.2 else rng.randint(0, 5), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string, n int, page_range double")
    keys, ties = [("name", "desc"), ("n", "asc")], ["id"]
    index = index_pages(df.repartition(4), keys, ties, -(-500 // ranges))
    whole = [tuple(r) for r in order_by(df, keys, ties).collect()]
    assert index.total == 500 and index.pages(33) == 16 and len(index.counts) == ranges
    for number in (1, 2, 9, 16, 99):
        at = 33 * (min(number, 16) - 1)
        assert [tuple(r) for r in index.page(number, 33).collect()] == whole[at : at + 33]
    assert index.rows_from(500, 10).collect() == [] and index.rows_from(499, 10).count() == 1
    last = index.page(16, 5)._jdf.queryExecution().toString()
    assert ranges == 1 or re.search(r"PartitionFilters: \[[^\]]*page_range_#\d+ = 1", last)
    assert index_pages(df.limit(0), keys).page(3).collect() == []


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(4000).selectExpr("id", "0 as k")
    index = index_pages(df, [("k", "asc")], range_rows=500)
    assert max(index.counts.values()) < 1000
    seen = [r["id"] for n in range(1, 9) for r in index.page(n, 500).collect()]
    assert sorted(seen) == list(range(4000))


def test_subtotals_of_three_dimensions(spark):
    rows = [(r, s, c, v) for r, s, c, v in [("x", "p", 1, 2), ("x", "p", 2, 4), ("x", None, 1, 4), ("y", "p", 1, 8), (None, "q", 2, 2), ("x", "p", 1, 6)]]
    df = spark.createDataFrame(rows, "r string, s string, c int, v int").withColumn("row", F.lit(1))
    out = R.pivot_subtotals(df, ["r", "s"], ["c"], [("v", "sum"), ("v", "avg"), ("v", "distinctCount")])
    levels = {(2, 1): (0, 1, 2), (2, 0): (0, 1), (1, 1): (0, 2), (1, 0): (0,), (0, 1): (2,), (0, 0): ()}
    want = set()
    for (rl, cl), dims in levels.items():
        for key in {tuple(x[d] if d in dims else None for d in range(3)) for x in rows}:
            mine = [x for x in rows if all(x[d] == key[d] for d in dims)]
            cells = {}
            for x in mine:
                cells.setdefault(x[:3], []).append(x[3])
            v = [x[3] for x in mine]
            want.add((*key, rl, cl, sum(v), sum(v), round(sum(v) / len(v), 6), round(sum(sum(c) / len(c) for c in cells.values()), 6), len(set(v)), sum(len(set(c)) for c in cells.values())))
    got = {(x["r"], x["s"], x["c"], x["row_level"], x["column_level"], x["v"], x["v_cells"], round(x["v_avg"], 6), round(x["v_avg_cells"], 6), x["v_distinctCount"], x["v_distinctCount_cells"]) for x in out.collect()}
    assert got == want and out.count() == len(want)
    assert R.pivot_subtotals(df, [], [], [("v", "sum")]).first()["v_cells"] == 26
