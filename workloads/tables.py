"""Filters, aggregates, ordering and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.display import display
from quillgrid.operators.aggregates import aggregate, order_by, page_of
from quillgrid.operators.filters import bound_filters, condition, control_filter, read_shorthand, where_all
from quillgrid.plans import reports as R
from quillgrid.plans.paging import index_pages

from .base import LABELLED, labelled_documents, load, query, rounded

# --- one number


def _kpi(name, table, column, function, sql, places=None):
    @query(name, f"select {sql} as {column} from {table}")
    def run(spark, sf):
        out = R.kpi(load(spark, sf, table), column, function)
        return rounded(out, **{column: places}) if places is not None else out


_kpi("kpi_sum", "lineitem", "l_extendedprice", "sum", "round(sum(l_extendedprice), 2)", 2)
_kpi("kpi_avg", "lineitem", "l_quantity", "avg", "round(avg(l_quantity), 6)", 6)
_kpi("kpi_count", "lineitem", "l_orderkey", "count", "count(l_orderkey)")
_kpi("kpi_min", "orders", "o_totalprice", "min", "min(o_totalprice)")
_kpi("kpi_max", "orders", "o_totalprice", "max", "max(o_totalprice)")
_kpi("kpi_distinct", "lineitem", "l_partkey", "distinctCount", "count(distinct l_partkey)")
_kpi("kpi_min_text", "customer", "c_mktsegment", "min", "min(c_mktsegment)")
_kpi("kpi_max_text", "customer", "c_name", "max", "max(c_name)")


@query("kpi_count_nulls", f"select count(quality) as quality from {LABELLED}")
def kpi_count_nulls(spark, sf):
    return R.kpi(labelled_documents(spark, sf), "quality", "count")


def _text_amounts(spark, sf):
    """Amounts as untyped text, where errors carry a word instead of a number."""
    word = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return load(spark, sf, "events").select("event_id", "event_type", word.alias("amount"))


@query("kpi_sum_text", "select round(sum(value), 2) as amount from events where event_type <> 'error'")
def kpi_sum_text(spark, sf):
    return rounded(R.kpi(_text_amounts(spark, sf), "amount", "sum"), amount=2)


@query("kpi_avg_text", "select round(avg(value), 6) as amount from events where event_type <> 'error'")
def kpi_avg_text(spark, sf):
    return rounded(R.kpi(_text_amounts(spark, sf), "amount", "avg"), amount=6)


@query(
    "kpi_comparison",
    """
    select s as o_totalprice, round(s - 1e9, 2) as diff, printf('%.1f', (s - 1e9) / 1e9 * 100)::double as pct_change,
           case when s > 1e9 then 'positive' when s < 1e9 then 'negative' else 'neutral' end as direction
    from (select round(sum(o_totalprice), 2) as s from orders)
    """,
)
def kpi_comparison(spark, sf):
    out = R.kpi(load(spark, sf, "orders"), "o_totalprice", "sum", previous=1e9)
    return rounded(out, o_totalprice=2, diff=2).drop("change_text")


# --- filters


def _filter(name, table, keys, filters, sql):
    @query(name, f"select {', '.join(keys)} from {LABELLED if table == 'labelled' else table} where {sql}")
    def run(spark, sf):
        df = labelled_documents(spark, sf) if table == "labelled" else load(spark, sf, table)
        return where_all(df, filters).select(*keys)


_ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_LABEL = ["doc_id", "lang", "quality"]
_filter("filter_eq", "orders", _ORDER, [("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'")
_filter("filter_eq_number_as_text", "part", ["p_partkey", "p_size"], [("p_size", "eq", "7")], "p_size = 7")
_filter("filter_eq_null", "labelled", _LABEL, [("quality", "eq", None)], "quality is null")
_filter("filter_neq", "labelled", _LABEL, [("quality", "neq", 1)], "quality is distinct from 1")
_filter("filter_neq_null", "labelled", _LABEL, [("quality", "neq", None)], "quality is not null")
_filter("filter_gt", "orders", _ORDER, [("o_totalprice", "gt", 400000)], "o_totalprice > 400000")
_filter("filter_gte", "part", ["p_partkey", "p_size"], [("p_size", "gte", 40)], "p_size >= 40")
_filter("filter_lt", "customer", ["c_custkey", "c_acctbal"], [("c_acctbal", "lt", 100.5)], "c_acctbal < 100.5")
_filter("filter_lte", "orders", ["o_orderkey"], [("o_orderdate", "lte", "1996-06-30")], "o_orderdate <= timestamp '1996-06-30'")
_filter("filter_in", "orders", _ORDER, [("o_orderstatus", "in", ["F", "P"])], "o_orderstatus in ('F', 'P')")
_filter("filter_in_numbers", "part", ["p_partkey", "p_size"], [("p_size", "in", [1, "2", 3])], "p_size in (1, 2, 3)")
_filter("filter_in_empty", "orders", _ORDER, [("o_orderstatus", "in", [])], "false")
_filter("filter_not_in", "labelled", _LABEL, [("quality", "not_in", [1])], "quality is null or quality not in (1)")
_filter("filter_not_in_empty", "labelled", _LABEL, [("quality", "not_in", [])], "true")
_filter("filter_between", "orders", _ORDER, [("o_totalprice", "between", [100000, 200000])], "o_totalprice between 100000 and 200000")
_filter("filter_between_one_bound", "orders", _ORDER, [("o_totalprice", "between", [100000])], "false")
_filter("filter_contains", "part", ["p_partkey", "p_name"], [("p_name", "contains", "RING")], "contains(lower(p_name), 'ring')")
_filter("filter_starts_with", "customer", ["c_custkey", "c_mktsegment"], [("c_mktsegment", "starts_with", "build")], "starts_with(lower(c_mktsegment), 'build')")
_filter("filter_ends_with", "orders", ["o_orderkey", "o_orderpriority"], [("o_orderpriority", "ends_with", "gent")], "ends_with(lower(o_orderpriority), 'gent')")
_filter("filter_is_null", "labelled", _LABEL, [("toxic", "is_null", None)], "toxic is null")
_filter("filter_is_not_null", "labelled", _LABEL, [("toxic", "is_not_null", None)], "toxic is not null")
_filter(
    "filter_conjunction", "orders", _ORDER,
    [("o_orderstatus", "neq", "O"), ("o_totalprice", "gte", 250000), ("o_orderpriority", "contains", "urgent")],
    "o_orderstatus <> 'O' and o_totalprice >= 250000 and contains(lower(o_orderpriority), 'urgent')",
)


@query(
    "filter_gt_text",
    """
    select event_id, event_type from events
    where case when event_type = 'error' then 'n/a' > '50' else value > 50 end
    """,
)
def filter_gt_text(spark, sf):
    df = _text_amounts(spark, sf)
    return df.where(condition(df, "amount", "gt", 50)).select("event_id", "event_type")


@query("filter_between_text", "select event_id from events where event_type <> 'error' and value between 20 and 30")
def filter_between_text(spark, sf):
    df = _text_amounts(spark, sf)
    return df.where(condition(df, "amount", "between", ["20", 30])).select("event_id")


@query(
    "filter_shorthand",
    "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('F', 'P') and o_orderpriority = '1-URGENT' and o_totalprice > 1000",
)
def filter_shorthand(spark, sf):
    df = load(spark, sf, "orders")
    entries = {
        "filter_o_orderstatus": ["F", "P"],
        "o_orderpriority": "1-URGENT",
        "price": {"columnKey": "o_totalprice", "operator": "gt", "value": 1000},
        "no_such_column": "ignored",
    }
    filters = [f for k, v in entries.items() if (f := read_shorthand(df.columns, k, v))]
    return where_all(df, filters).select(*_ORDER)


@query("filter_binding", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def filter_binding(spark, sf):
    df = load(spark, sf, "orders")
    active = {"filter_o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    bound = bound_filters(df.columns, [("o_totalprice", "gt", 100000)], active, ["filter_o_orderstatus"])
    return where_all(df, bound).select(*_ORDER)


def _control(name, kind, table, column, value, keys, sql):
    @query(name, f"select {', '.join(keys)} from {table} where {sql}")
    def run(spark, sf):
        return where_all(load(spark, sf, table), [control_filter(kind, column, value)]).select(*keys)


_control("filter_control_select", "select", "customer", "c_mktsegment", "BUILDING", ["c_custkey"], "c_mktsegment = 'BUILDING'")
_control("filter_control_multi_select", "multi-select", "events", "event_type", ["click", "view"], ["event_id"], "event_type in ('click', 'view')")
_control("filter_control_date_range", "date-range", "orders", "o_orderdate", ("1997-01-01", ""), ["o_orderkey"], "o_orderdate between timestamp '1997-01-01' and timestamp '2099-12-31'")
_control("filter_control_numeric_range", "numeric-range", "orders", "o_totalprice", (None, 50000), ["o_orderkey"], "o_totalprice between -1e12 and 50000")
_control("filter_control_search", "search", "part", "p_name", "blue", ["p_partkey"], "contains(lower(p_name), 'blue')")

# --- projection, groups, order


@query("select_all", "select * from customer")
def select_all(spark, sf):
    return where_all(load(spark, sf, "customer"), [])


@query("projection", "select c_custkey, c_mktsegment from customer")
def projection(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_mktsegment")


@query(
    "group_one",
    """
    select l_returnflag, round(sum(l_extendedprice), 2) as revenue, round(avg(l_quantity), 6) as mean_quantity,
           count(l_tax) as n, min(l_discount) as low, max(l_discount) as high, count(distinct l_suppkey) as suppliers
    from lineitem group by l_returnflag
    """,
)
def group_one(spark, sf):
    out = aggregate(
        load(spark, sf, "lineitem"),
        ["l_returnflag"],
        [
            ("l_extendedprice", "sum", "revenue"),
            ("l_quantity", "avg", "mean_quantity"),
            ("l_tax", "count", "n"),
            ("l_discount", "min", "low"),
            ("l_discount", "max", "high"),
            ("l_suppkey", "distinctCount", "suppliers"),
        ],
    )
    return rounded(out, revenue=2, mean_quantity=6)


@query(
    "group_two",
    "select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(l_orderkey) as n from lineitem group by l_returnflag, l_linestatus",
)
def group_two(spark, sf):
    measures = [("l_quantity", "sum", "quantity"), ("l_orderkey", "count", "n")]
    return aggregate(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], measures)


@query("group_many_keys", "select l_partkey, l_suppkey, sum(l_quantity) as quantity from lineitem group by l_partkey, l_suppkey")
def group_many_keys(spark, sf):
    return aggregate(load(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], [("l_quantity", "sum", "quantity")])


@query("group_null_key", f"select quality, count(doc_id) as n from {LABELLED} group by quality")
def group_null_key(spark, sf):
    return aggregate(labelled_documents(spark, sf), ["quality"], [("doc_id", "count", "n")])


@query("global_aggregate", "select sum(l_quantity) as quantity, count(distinct l_returnflag) as flags, strftime(min(l_shipdate), '%Y-%m-%d') as first_day from lineitem")
def global_aggregate(spark, sf):
    measures = [("l_quantity", "sum", "quantity"), ("l_returnflag", "distinctCount", "flags"), ("l_shipdate", "min", "first_day")]
    return aggregate(load(spark, sf, "lineitem"), [], measures).withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd"))


@query("distinct_dims", "select distinct o_orderstatus, o_orderpriority from orders")
def distinct_dims(spark, sf):
    return aggregate(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "order_nulls_last",
    f"select doc_id, quality from {LABELLED} order by quality desc nulls last, doc_id limit 300",
)
def order_nulls_last(spark, sf):
    return page_of(order_by(labelled_documents(spark, sf), [("quality", "desc")], ties=["doc_id"]), 300).select("doc_id", "quality")


@query("order_text_locale", "select p_partkey, p_name from part order by p_name, p_partkey limit 200")
def order_text_locale(spark, sf):
    return page_of(order_by(load(spark, sf, "part"), [("p_name", "asc")], ties=["p_partkey"]), 200).select("p_partkey", "p_name")


@query("limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 25")
def limit_offset(spark, sf):
    ranked = order_by(load(spark, sf, "orders"), [("o_totalprice", "desc")], ties=["o_orderkey"])
    return page_of(ranked, 50, 25).select("o_orderkey", "o_totalprice")


# --- reports


def _trend(name, granularity, sql):
    @query(name, f"select strftime({sql}, '%Y-%m-%d') as o_orderdate, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1")
    def run(spark, sf):
        out = R.trend(load(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], granularity=granularity)
        return rounded(out, o_totalprice=2).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


_trend("trend_as_is", None, "o_orderdate")
for _g in R.GRANULARITIES:
    _trend(f"trend_{_g}", _g, f"date_trunc('{_g}', o_orderdate)")


@query(
    "trend_two_measures",
    "select strftime(l_shipdate, '%Y-%m-%d') as l_shipdate, sum(l_quantity) as l_quantity, round(sum(l_extendedprice), 2) as l_extendedprice from lineitem group by 1",
)
def trend_two_measures(spark, sf):
    out = R.trend(load(spark, sf, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"])
    return rounded(out, l_extendedprice=2).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query(
    "revenue_by_flag",
    """
    select l_returnflag, round(sum(l_extendedprice), 2) as l_extendedprice from lineitem
    where l_linestatus = 'F' group by l_returnflag order by l_extendedprice desc limit 20
    """,
)
def revenue_by_flag(spark, sf):
    kept = where_all(load(spark, sf, "lineitem"), [("l_linestatus", "eq", "F")])
    return rounded(R.bars(kept, "l_returnflag", ["l_extendedprice"]), l_extendedprice=2)


@query(
    "bar_topn",
    "select l_suppkey, round(sum(l_extendedprice), 2) as l_extendedprice from lineitem group by l_suppkey order by sum(l_extendedprice) desc, l_suppkey limit 20",
)
def bar_topn(spark, sf):
    return rounded(R.bars(load(spark, sf, "lineitem"), "l_suppkey", ["l_extendedprice"]), l_extendedprice=2)


@query("bar_by_label", "select p_brand, sum(p_size)::bigint as p_size from part group by p_brand order by p_brand limit 10")
def bar_by_label(spark, sf):
    return R.bars(load(spark, sf, "part"), "p_brand", ["p_size"], sort=("label", "asc"), limit=10)


@query("bar_count", "select event_type, count(event_type) as count_records from events group by event_type")
def bar_count(spark, sf):
    return R.bars(load(spark, sf, "events"), "event_type", ["event_type"], "count")


@query(
    "donut_share",
    """
    with top as (select p_brand, sum(p_size)::bigint as p_size from part group by p_brand order by p_size desc, p_brand limit 7)
    select p_brand, p_size, printf('%.1f', p_size / (select sum(p_size) from top) * 100)::double as share from top
    """,
)
def donut_share(spark, sf):
    return R.donut(load(spark, sf, "part"), "p_brand", "p_size", slices=7)


@query("table_records", "select p_name, p_brand, p_retailprice from part order by p_retailprice desc, p_partkey")
def table_records(spark, sf):
    out = R.record_table(load(spark, sf, "part"), ["p_name", "p_brand", "p_retailprice", "p_partkey"], ("p_retailprice", "desc"), ties=["p_partkey"])
    return out.drop("p_partkey")


@query("table_search", "select p_partkey, p_name, p_brand, p_size from part where contains(lower(p_name), '11') or contains(lower(p_brand), '11') or contains(p_partkey::varchar, '11') or contains(p_size::varchar, '11')")
def table_search(spark, sf):
    return R.search_table(load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), " 11 ")


@query("table_page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def table_page(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.page(df, 3, 25, [("o_totalprice", "desc")], ties=["o_orderkey"])


@query(
    "table_last_page",
    "select n_nationkey, n_name from nation order by n_nationkey limit 10 offset 10 * ((select greatest(1, ceil(count(*) / 10)) from nation)::bigint - 1)",
)
def table_last_page(spark, sf):
    return R.page(load(spark, sf, "nation").select("n_nationkey", "n_name"), 999, 10, [("n_nationkey", "asc")])


_BY_PRICE = "order by l_extendedprice desc nulls last, l_orderkey, l_linenumber"


@query(
    "table_deep_page",
    f"""
    select l_orderkey, l_linenumber, l_extendedprice from lineitem {_BY_PRICE}
    limit 50 offset 50 * (select greatest(1, ceil(count(*) / 50)) - 1 from lineitem)::bigint
    """,
)
def table_deep_page(spark, sf):
    """The last page of the line items by price, from the one range that holds it."""
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return index_pages(df, [("l_extendedprice", "desc")], ["l_orderkey", "l_linenumber"], range_rows=10_000).page(10**9, 50)


@query(
    "pivot_subtotals",
    """
    with d as (select o_orderpriority as p, o_orderstatus as s, year(o_orderdate) as y, round(o_totalprice * 100)::bigint as t, o_custkey as c from orders),
    cells as (select p, s, y, sum(t) as total, count(distinct c) as customers from d group by 1, 2, 3)
    select a.*, total_cells, customers_cells from (
      select p as o_orderpriority, s as o_orderstatus, y as o_year, (1 - grouping(p)) + (1 - grouping(s)) as row_level, 1 - grouping(y) as column_level,
             sum(t)::bigint as total, avg(t) as mean, count(distinct c) as customers
      from d group by grouping sets ((p, s, y), (p, s), (p, y), (p), (y), ())) a
    join (
      select p, s, y, (1 - grouping(p)) + (1 - grouping(s)) as r, 1 - grouping(y) as k,
             sum(total)::bigint as total_cells, sum(customers)::bigint as customers_cells
      from cells group by grouping sets ((p, s, y), (p, s), (p, y), (p), (y), ())) b
    on r = row_level and k = column_level and p is not distinct from o_orderpriority and s is not distinct from o_orderstatus and y is not distinct from o_year
    """,
)
def pivot_subtotals(spark, sf):
    """Priority and status by year with subtotals; averages and distinct customers do not add up."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    df = load(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("o_year"), cents.alias("total"), cents.alias("mean"), F.col("o_custkey").alias("customers"))
    # Sums of averages depend on their order in the last digits, so they are left to the tests.
    return R.pivot_subtotals(df, ["o_orderpriority", "o_orderstatus"], ["o_year"], [("total", "sum"), ("mean", "avg"), ("customers", "distinctCount")]).drop("mean_cells")


@query("table_page_count", "select greatest(1, ceil(count(*) / 25))::bigint as total_pages from orders")
def table_page_count(spark, sf):
    return R.page_count(load(spark, sf, "orders"), 25)


@query(
    "pivot_long",
    """
    select l_returnflag, l_linestatus, sum(l_quantity) as l_quantity, round(avg(l_quantity), 6) as l_quantity_avg
    from lineitem group by l_returnflag, l_linestatus
    """,
)
def pivot_long(spark, sf):
    out = R.pivot_long(load(spark, sf, "lineitem"), ["l_returnflag"], ["l_linestatus"], [("l_quantity", "sum"), ("l_quantity", "avg")])
    return rounded(out, l_quantity_avg=6)


@query(
    "pivot_matrix",
    """
    select o_orderpriority, coalesce(round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2), 0) as "F",
           coalesce(round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2), 0) as "O",
           coalesce(round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2), 0) as "P"
    from orders group by o_orderpriority
    """,
)
def pivot_matrix(spark, sf):
    return rounded(R.pivot_matrix(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ("o_totalprice", "sum"), ["F", "O", "P"]), F=2, O=2, P=2)


_CELLS = """
with cells as (select coalesce(lang, '—') as row_label, coalesce(quality::varchar, '—') as col_label, {value} as value
               from {table} group by 1, 2)
select row_label, col_label, {sum} as value,
       case grouping(row_label) * 2 + grouping(col_label) when 0 then 'cell' when 1 then 'row_total'
            when 2 then 'column_total' else 'grand_total' end as kind
from cells group by cube (row_label, col_label)
"""


@query("pivot_totals", _CELLS.format(value="sum(n_chars)::bigint", table=LABELLED, sum="sum(value)::bigint"))
def pivot_totals(spark, sf):
    return R.pivot_totals(labelled_documents(spark, sf), "lang", "quality", ("n_chars", "sum"))


@query("pivot_totals_of_averages", _CELLS.format(value="avg(n_chars)", table=LABELLED, sum="round(sum(value), 4)"))
def pivot_totals_of_averages(spark, sf):
    return rounded(R.pivot_totals(labelled_documents(spark, sf), "lang", "quality", ("n_chars", "avg")), value=4)


_GUARD = "case when left({0}, 1) in ('=', '+', '-', '@', '|') then '''' || {0} else {0} end"
_MONEY = "case when c_acctbal < 0 then '-' else '' end || '$' || case when c_acctbal = round(c_acctbal) then format('{:,.0f}', abs(c_acctbal)) else format('{:,.2f}', abs(c_acctbal)) end"


@query("display_currency", f"select c_custkey, {_GUARD.format('shown')} as shown from (select c_custkey, {_MONEY} as shown from customer)")
def display_currency(spark, sf):
    df = load(spark, sf, "customer")
    return df.select("c_custkey", display(F.col("c_acctbal"), df.schema["c_acctbal"].dataType, currency="USD").alias("shown"))


@query(
    "display_compact",
    """
    select o_orderkey, (tenths // 10)::varchar || case when tenths % 10 = 0 then '' else '.' || (tenths % 10)::varchar end || 'K' as shown
    from (select o_orderkey, (round(o_totalprice * 100)::bigint + 5000) // 10000 as tenths from orders)
    """,
)
def display_compact(spark, sf):
    df = load(spark, sf, "orders")
    return df.select("o_orderkey", display(F.col("o_totalprice"), df.schema["o_totalprice"].dataType, notation="compact", precision=1).alias("shown"))


@query(
    "display_percent",
    f"select doc_id, case when quality is null then '—' else (quality * 100)::varchar || '.0%' end as quality, coalesce(toxic::varchar || '.00 pts', '—') as toxic from {LABELLED}",
)
def display_percent(spark, sf):
    df = labelled_documents(spark, sf)
    quality = display(F.col("quality"), df.schema["quality"].dataType, scale=100, suffix="%", precision=1)
    toxic = display(F.col("toxic"), df.schema["toxic"].dataType, suffix=" pts", precision=2)
    return df.select("doc_id", quality.alias("quality"), toxic.alias("toxic"))


@query(
    "report_runner",
    """
    select 'kpi' as report, 'all' as label, round(sum(o_totalprice), 2) as value from orders where o_orderstatus = 'F'
    union all
    select 'bar', o_orderpriority, round(sum(o_totalprice), 2) from orders where o_orderstatus = 'F' group by 2
    union all
    select 'unbound', o_orderstatus, round(sum(o_totalprice), 2) from orders group by 2
    """,
)
def report_runner(spark, sf):
    reports = [
        {"id": "kpi", "type": "kpi", "measure": "o_totalprice"},
        {"id": "bar", "type": "bar", "dimension": "o_orderpriority", "measures": ["o_totalprice"], "bindings": ["filter_o_orderstatus"]},
        {"id": "unbound", "type": "bar", "dimension": "o_orderstatus", "measures": ["o_totalprice"], "bindings": ["filter_o_orderdate"]},
        {"id": "broken", "type": "bar", "dimension": "no_such_column", "measures": ["o_totalprice"]},
    ]
    found = R.run_reports(load(spark, sf, "orders"), reports, {"filter_o_orderstatus": "F"})
    assert isinstance(found.pop("broken"), Exception)
    parts = [
        df.select(F.lit(name).alias("report"), (F.col(df.columns[0]) if len(df.columns) > 1 else F.lit("all")).alias("label"), F.col("o_totalprice").alias("value"))
        for name, df in found.items()
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), value=2)
