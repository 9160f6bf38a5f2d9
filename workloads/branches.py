"""Branches of inference, headers, names and drift that the other queries do not reach, over columns made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import drift as D
from quillgrid.operators import profile as P
from quillgrid.operators.grid import normalise_grid, to_table
from quillgrid.plans.autoreport import auto_report
from quillgrid.session import stored
from quillgrid.sources.catalog import register

from .base import _cells, load, query

#: Column, its type and currency, and the text it holds in Spark's and in DuckDB's words.
_LOOKS = [
    ("nothing", "text", None, "cast(null as string)", "null::varchar"),
    ("revenue_plan", "currency", "USD", "cast(null as string)", "null::varchar"),
    ("is_open", "boolean", None, "if(o_orderstatus = 'O', 'true', 'false')", "case when o_orderstatus = 'O' then 'true' else 'false' end"),
    ("growth", "percent", None, "concat(o_custkey % 90, '.5%')", "(o_custkey % 90)::varchar || '.5%'"),
    ("start_serial", "date", None, "cast(45000 + o_orderkey % 300 as string)", "(45000 + o_orderkey % 300)::varchar"),
    ("fee", "currency", "EUR", "concat('€', cast(o_totalprice as decimal(18,2)))", "'€' || o_totalprice::decimal(18,2)::varchar"),
    ("loss", "currency", "USD", "concat('(', o_custkey % 50 + 1, '00.00)')", "'(' || (o_custkey % 50 + 1)::varchar || '00.00)'"),
    ("budget gbp", "currency", "GBP", "if(o_orderkey % 9 = 0, null, cast(o_custkey as string))", "case when o_orderkey % 9 <> 0 then o_custkey::varchar end"),
    ("units_sold", "number", None, "cast(o_custkey % 40 as string)", "(o_custkey % 40)::varchar"),
]


def _looks_sql():
    parts = []
    for key, kind, code, _, sql in _LOOKS:
        currency = f"'{code}'" if code else "null"
        parts.append(f"select '{key}' as column_key, '{kind}' as inferred_type, {currency} as currency_code, count(*) as total_count, count(*) - count({sql}) as null_count, count(distinct {sql}) as distinct_count from orders")
    return " union all ".join(parts)


@query("profile_branches", _looks_sql())
def profile_branches(spark, sf):
    """Every branch of the inference over text: blank, boolean, percent, serial date, currency by sign, brackets, name and code."""
    df = load(spark, sf, "orders").select(*[F.expr(text).alias(key) for key, _, _, text, _ in _LOOKS])
    return P.describe_columns(df, kinds_by_look=True).select("column_key", "inferred_type", "currency_code", "total_count", "null_count", "distinct_count")


@query("registered_table", "select o_orderpriority, count(*) as n from orders group by 1")
def registered_table(spark, sf):
    """A table registered under a name that is no identifier, found again under its id."""
    name = register(load(spark, sf, "orders"), "Q3 Orders!", "orders_of_q3")
    return spark.sql(f"select o_orderpriority, count(*) as n from {name} group by 1")


def _two_tier_sheets(spark, sf):
    """Orders in a sheet per priority under a header of two rows, with an empty column between the groups."""
    none = F.lit(None).cast("string")
    orders = load(spark, sf, "orders")
    sheets = orders.select("o_orderpriority").distinct()
    top = sheets.select("o_orderpriority", F.lit(0).cast("long").alias("row_idx"), _cells(F.lit("Order"), none, none, F.lit("Amounts"), none).alias("cells"))
    second = sheets.select("o_orderpriority", F.lit(1).cast("long").alias("row_idx"), _cells(F.lit("Number"), F.lit("Status"), none, F.lit("Price"), F.lit("Customer")).alias("cells"))
    data = orders.select(
        "o_orderpriority", (F.col("o_orderkey") + 2).cast("long").alias("row_idx"),
        _cells(F.col("o_orderkey"), F.col("o_orderstatus"), none, F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_custkey")).alias("cells"),
    )
    grid = top.unionByName(second).unionByName(data).select(F.col("o_orderpriority").alias("file_id"), F.lit("s").alias("sheet"), "row_idx", "cells")
    ranges = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(("merge_idx", "start_row", "start_col", "end_row", "end_col"), r, ("int", "long", "int", "long", "int"))]) for r in ((0, 0, 0, 0, 1), (1, 0, 3, 0, 4))])
    return stored(grid), sheets.select(F.col("o_orderpriority").alias("file_id"), F.lit("s").alias("sheet"), F.inline(ranges))


_TWO_TIER = ["order_number", "order_status", "amounts_price", "amounts_customer"]


@query(
    "two_tier_grid",
    """
    select o_orderpriority as file_id, o_orderkey::varchar as order_number, o_orderstatus as order_status, o_totalprice::decimal(18,2)::varchar as amounts_price,
           o_custkey::varchar as amounts_customer from orders
    """,
)
def two_tier_grid(spark, sf):
    _, records = normalise_grid(*_two_tier_sheets(spark, sf))
    return to_table(records, _TWO_TIER).select("file_id", *_TWO_TIER)


@query("two_tier_headers", "select distinct o_orderpriority as file_id, 1 as header_row, 'order_number,order_status,amounts_price,amounts_customer' as keys from orders")
def two_tier_headers(spark, sf):
    """One header a sheet: names of both tiers together, the empty column gone."""
    headers, _ = normalise_grid(*_two_tier_sheets(spark, sf))
    return headers.select("file_id", "header_row", F.array_join("keys", ",").alias("keys"))


@query("auto_records", "select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey, o_orderdate from orders")
def auto_records(spark, sf):
    """The records that a report over orders shows: its key, dimensions, measures, and what is left."""
    return auto_report(load(spark, sf, "orders"), F.col("o_orderkey"))["table_records"]


@query(
    "drift_coercible",
    """
    select 'o_orderkey' as key, 'coercible' as status, count(distinct o_orderkey) as n_values from orders union all
    select 'o_totalprice', 'coercible', count(distinct o_totalprice) from orders union all
    select 'o_custkey', 'matched', count(distinct o_custkey) from orders union all
    select 'o_orderpriority', 'coercible', count(distinct o_orderpriority) from orders union all
    select 'o_orderstatus', 'mismatch', count(distinct o_orderstatus) from orders union all
    select 'o_orderdate', 'mismatch', count(distinct o_orderdate) from orders
    """,
)
def drift_coercible(spark, sf):
    """Types that can serve for the expected ones, and types that cannot."""
    kinds = {"o_orderkey": "text", "o_totalprice": "number", "o_custkey": "number", "o_orderpriority": "text", "o_orderstatus": "currency", "o_orderdate": "boolean"}
    expected = spark.createDataFrame([("orders", i, k, t) for i, (k, t) in enumerate(kinds.items())], "expectation_id string, ordinal int, key string, type string")
    profile = stored(P.describe_columns(load(spark, sf, "orders")))
    compared = D.compare_schemas(expected, D.schema_rows(profile, "orders"))
    return compared.join(profile.select(F.col("column_key").alias("key"), F.col("distinct_count").alias("n_values")), "key").select("key", "status", "n_values")
