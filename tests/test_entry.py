"""Registered queries against their SQL on the smallest data, if it is there."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

SF = "/root/testdata/sf0.001"
# A few of each kind; check.py runs all of them.
NAMES = """
revenue_by_flag kpi_comparison filter_gt_text filter_not_in filter_shorthand group_one order_nulls_last trend_quarter
donut_share table_page pivot_totals display_currency report_runner profile_counts profile_numeric profile_top
join_candidates numeric_parse auto_donut ask_top ask_sql drift_renames fingerprint header_detect grid_table merge_fill
line_flags lines_noise parse_dates csv_round_trip audit_files minute_quota
""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(NAMES) <= set(oracle)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "l_extendedprice"]
