import datetime as dt
import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.dates import parse_date, serial_date
from quillgrid.functions.display import comparison, display
from quillgrid.functions.numbers import coerced_number, fixed, parse_numeric
from quillgrid.functions.similarity import name_similarity, name_tokens, token_overlap
from quillgrid.functions.text import KEY_PATTERN, category_label, header_key, neutralise, plain_number, sample_label, unique_keys


def applied(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("out")).collect()]


def test_parse_numeric(spark):
    cases = {
        "(1,234.50)": -1234.5, "($1,234.50)": -1234.5, "$12": 12.0, " €7 ": 7.0, "-5%": -5.0, "12 %": 12.0, "0x10": 16.0, "1e5": 1e5,
        "--5": 5.0, "(-5)": -5.0, "+7": 7.0, "abc": None, "": None, "NaN": None, "1d": None, "Infinity": None, "1e999": None, "1 2": None,
    }
    assert applied(spark, list(cases), parse_numeric) == list(cases.values())


def test_coerced_number(spark):
    cases = {"": 0.0, "  ": 0.0, " 12 ": 12.0, "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, ".5": 0.5, "5.": 5.0, "1,000": None, "1f": None, "-Infinity": -math.inf}
    assert applied(spark, list(cases), coerced_number) == list(cases.values())


def test_header_key(spark):
    cases = {
        "Employee ID": "employee_id", "firstName2X": "first_name2_x", "  Unit  Price ($) ": "unit_price", "2020 Total": "_2020_total",
        "": "col_1", "___": "col_1", "日本": "col_1", "__proto__": "safe___proto__", "Constructor": "safe_constructor", "constructor!": "safe_constructor",
        "x" * 200: "x" * 120,
    }
    assert applied(spark, list(cases), lambda c: header_key(c, F.lit(0))) == list(cases.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_keys_are_safe_and_unique(spark, names):
    keys = applied(spark, names, lambda c: header_key(c, F.lit(0)))
    unique = spark.createDataFrame([(keys,)], "k array<string>").select(unique_keys(F.col("k"))).first()[0]
    assert len(set(unique)) == len(names)
    import re

    assert all(re.match(KEY_PATTERN, k) for k in unique)


def test_unique_keys_see_earlier_results(spark):
    df = spark.createDataFrame([(["a", "a", "a_1", "b", "a"],), (["x", "y"],)], "k array<string>")
    assert [r[0] for r in df.select(unique_keys(F.col("k"))).collect()] == [["a", "a_1", "a_1_1", "b", "a_2"], ["x", "y"]]


def test_neutralise_and_labels(spark):
    texts = ["=1+1", " -5", "\t=cmd", "|pipe", "@a", "plain", "", None, "a=b"]
    assert applied(spark, texts, neutralise) == ["'=1+1", "' -5", "'\t=cmd", "'|pipe", "'@a", "plain", "", None, "a=b"]
    assert applied(spark, [None, " ", "=x" + "y" * 200], category_label) == ["null", "(empty)", "'=x" + "y" * 97]
    assert applied(spark, [None, "  word ", "+" + "1" * 60], sample_label) == ["", "word", "'+" + "1" * 38]


def test_plain_number(spark):
    assert applied(spark, [1.0, 12345678.5, 0.1, -3.25, 1e13, 0.0], plain_number, "double") == ["1", "12345678.5", "0.1", "-3.25", "10000000000000", "0"]


def test_serial_dates(spark):
    assert applied(spark, [45200.0, 45200.9, 1.0, 60.0, 61.0], serial_date, "double") == [
        dt.date(2023, 10, 1), dt.date(2023, 10, 1), dt.date(1900, 1, 1), dt.date(1900, 3, 1), dt.date(1900, 3, 1),
    ]
    assert applied(spark, [43738.0], lambda c: serial_date(c, 1904), "double") == [dt.date(2023, 10, 1)]


def test_parse_dates(spark):
    cases = {
        "2024-01-05": dt.date(2024, 1, 5), "2024/1/5T10:00:00Z": dt.date(2024, 1, 5), "01/13/2024": dt.date(2024, 1, 13), "13/01/2024": dt.date(2024, 1, 13),
        "12-Jan-2024": dt.date(2024, 1, 12), "january 12, 2024": dt.date(2024, 1, 12), "Mar 2024": dt.date(2024, 3, 1), "2024 March": dt.date(2024, 3, 1),
        "3/4/24": dt.date(2024, 3, 4), "2024-13-45": None, "soon": None,
    }
    assert applied(spark, list(cases), parse_date) == list(cases.values())
    assert applied(spark, ["3/4/24"], lambda c: parse_date(c, day_first=True)) == [dt.date(2024, 4, 3)]


def test_fixed_rounds_the_stored_value(spark):
    assert applied(spark, [0.00015, 0.00005, 0.04165, 0.03125, -0.00015, 1.0], lambda c: fixed(c, 4), "double") == [0.0001, 0.0001, 0.0416, 0.0313, -0.0001, 1.0]


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, ["1,234,567.89", "0.50", "'-1,234.50", "12", "—"]),
        ({"currency": "USD"}, ["$1,234,567.89", "$0.50", "'-$1,234.50", "$12", "—"]),
        ({"currency": "GBP", "precision": 0}, ["£1,234,568", "£1", "'-£1,235", "£12", "—"]),
        ({"notation": "compact", "precision": 1}, ["1.2M", "0.5", "'-1.2K", "12", "—"]),
        ({"notation": "scientific", "precision": 2}, ["1.23e+6", "5.00e-1", "'-1.23e+3", "1.20e+1", "—"]),
        ({"scale": 100, "suffix": "%", "precision": 1}, ["123,456,789.1%", "50.0%", "'-123,450.0%", "1,200.0%", "—"]),
    ],
)
def test_display(spark, options, expected):
    values = [1234567.891, 0.5, -1234.5, 12.0, None]
    assert applied(spark, values, lambda c: display(c, T.DoubleType(), **options), "double") == expected


def test_display_of_other_kinds(spark):
    assert applied(spark, [True, False, None], lambda c: display(c, T.BooleanType()), "boolean") == ["True", "False", "—"]
    assert applied(spark, ["=x", "1234.5", "word", None], lambda c: display(c, T.StringType())) == ["'=x", "1,234.50", "word", "—"]
    assert applied(spark, [999_960.0], lambda c: display(c, T.DoubleType(), notation="compact", precision=1), "double") == ["1M"]


def test_comparison(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in comparison(F.lit(90.0), previous=100.0, target=5.0).items()]).first()
    assert tuple(row) == (-10.0, -10.0, "negative", "-10.0%")
    assert spark.range(1).select(comparison(F.lit(9.0), target=0.0)["diff"]).first()[0] is None


def test_name_similarity(spark):
    pairs = [("emp_id", "employee_id"), ("Order", "order"), ("a", "b"), ("revenue", "total_revenue"), ("custName", "cust_name")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [tuple(r) for r in df.select(name_similarity(F.col("a"), F.col("b")), token_overlap(F.col("a"), F.col("b"))).collect()]
    # 0.4 * (1 - 5/11) + 0.5; equal ignoring case; nothing alike; 0.4 * (1 - 6/13) + 0.25 + 0.2.
    assert got[0] == (0.718, 1.0) and got[1][0] == 1.0 and got[2] == (0.0, 0.0) and got[3] == (0.665, 0.5)
    assert applied(spark, ["custName_2X"], name_tokens) == [["cust", "name", "2", "x"]]


def test_unique_keys_of_wide_headers(spark):
    """Some 30,000 repeated keys take seconds; every comparison with all earlier keys would take hours."""
    keys = [f"k{i % 7}" for i in range(30_000)] + ["k0_1", None, "k0_9999"]
    df = spark.createDataFrame([(0, keys), (1, None), (2, [])], "i int, k array<string>")
    begun = time.monotonic()
    found = [r[0] for r in df.orderBy("i").select(unique_keys(F.col("k"))).collect()]
    assert time.monotonic() - begun < 30 and found[1:] == [None, []]
    assert found[0][:-3] == [f"k{i % 7}_{i // 7}" if i >= 7 else f"k{i}" for i in range(30_000)] and found[0][-3:] == ["k0_1_1", None, "k0_9999"]
