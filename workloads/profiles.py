"""Column profiles, join keys, automatic reports and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.numbers import parse_numeric
from quillgrid.operators import profile as P
from quillgrid.operators.joinkeys import find_join_candidates
from quillgrid.plans.adhoc import ask_sql
from quillgrid.plans.ask import ask
from quillgrid.plans.autoreport import auto_report, choose_reports, default_filters
from quillgrid.sources.catalog import active_table, row_counts

from .base import LABELLED, labelled_documents, load, query, rounded


def _per_column(columns, sql):
    return " union all ".join(sql.format(c=c, i=i) for i, c in enumerate(columns))


def _counts_sql(columns, table):
    return _per_column(
        columns,
        f"""
        select {{i}} as ordinal, '{{c}}' as column_key, count(*) as total_count, count(*) - count({{c}}) as null_count,
               count(*) > count({{c}}) as nullable, count(distinct {{c}}) as distinct_count,
               printf('%.4f', count(distinct {{c}}) / count(*))::double as uniqueness_ratio from {table}
        """,
    )


_COUNTS = ["ordinal", "column_key", "total_count", "null_count", "nullable", "distinct_count", "uniqueness_ratio"]
_LABEL_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_counts", _counts_sql(_LABEL_COLUMNS, LABELLED))
def profile_counts(spark, sf):
    return P.describe_columns(labelled_documents(spark, sf), F.col("doc_id")).select(*_COUNTS)


@query("profile_counts_lineitem", _counts_sql(_LINE_COLUMNS, "lineitem"))
def profile_counts_lineitem(spark, sf):
    return P.describe_columns(load(spark, sf, "lineitem")).select(*_COUNTS)


@query(
    "profile_numeric",
    _per_column(
        ["o_orderkey", "o_custkey", "o_totalprice"],
        """
        select '{c}' as column_key, min({c})::double as min, max({c})::double as max, round(sum({c}), 2)::double as sum,
               round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(var_pop({c}) / 1e6, 4) as variance,
               round(stddev_pop({c}), 4) as std_dev from orders
        """,
    ),
)
def profile_numeric(spark, sf):
    out = P.profile_table(load(spark, sf, "orders"), F.col("o_orderkey"), parts=["stats"]).where("stats is not null")
    flat = out.select("column_key", "stats.*").withColumn("variance", F.col("variance") / 1e6)
    return rounded(flat, sum=2, mean=4, median=4, variance=4, std_dev=4)


@query(
    "profile_numeric_text",
    """
    select 'amount' as column_key, min(value)::double as min, max(value)::double as max, round(sum(value), 2) as sum, round(avg(value), 4) as mean,
           round(median(value), 4) as median, round(var_pop(value), 4) as variance, round(stddev_pop(value), 4) as std_dev from events
    """,
)
def profile_numeric_text(spark, sf):
    """Amounts written with a currency sign, negative ones in brackets."""
    value = F.col("value").cast("decimal(18,2)")
    text = F.when(value < 0, F.concat(F.lit("($"), (-value).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("$"), value.cast("string")))
    df = load(spark, sf, "events").select("event_id", text.alias("amount"))
    out = P.profile_table(df, F.col("event_id"), parts=["stats"]).where("column_key = 'amount'")
    return rounded(out.select("column_key", "stats.*"), sum=2, mean=4, median=4, variance=4, std_dev=4)


def _tops_sql(columns, table, order):
    return _per_column(
        columns,
        f"""
        select * from (select '{{c}}' as column_key, {{c}}::varchar as value, count(*) as "count",
                 printf('%.2f', count(*) / (select count(*) from {table}) * 100)::double as percentage,
                 row_number() over (order by count(*) desc, min({order})) as rank
               from {table} where {{c}} is not null group by {{c}}) where rank <= 50
        """,
    )


def _unrolled(profile):
    return profile.select("column_key", F.posexplode("top_values").alias("place", "v")).select("column_key", "v.*", (F.col("place") + 1).alias("rank"))


@query("profile_top", _tops_sql(["o_orderstatus", "o_orderpriority"], "orders", "o_orderkey"))
def profile_top(spark, sf):
    return _unrolled(P.profile_table(load(spark, sf, "orders"), F.col("o_orderkey"), parts=["top_values"]))


@query("profile_top_part", _tops_sql(["p_brand", "p_type", "p_size"], "part", "p_partkey"))
def profile_top_part(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return _unrolled(P.profile_table(df, F.col("p_partkey"), parts=["top_values"]))


@query(
    "profile_samples",
    _per_column(
        ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
        """
        select * from (select '{c}' as column_key, left({c}::varchar, 40) as sample,
                 row_number() over (order by min(c_custkey)) as rank from customer group by 2) where rank <= 5
        """,
    ),
)
def profile_samples(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    out = P.profile_table(df, F.col("c_custkey"), parts=["sample_values"])
    return out.select("column_key", F.posexplode("sample_values").alias("place", "sample")).select("column_key", "sample", (F.col("place") + 1).alias("rank"))


@query(
    "profile_long_text",
    """
    select 'text' as column_key, string_agg(sample, chr(10) order by rank) as sample_values from (
      select case when left(t, 1) in ('=', '+', '-', '@', '|') then left('''' || t, 40) else left(t, 40) end as sample,
             row_number() over (order by min(doc_id)) as rank
      from (select doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279)) as t from documents) where t <> ''
      group by 1) where rank <= 5
    """,
)
def profile_long_text(spark, sf):
    """Whole documents as one text column."""
    df = load(spark, sf, "documents").select("doc_id", "text")
    return P.profile_table(df, F.col("doc_id"), parts=["sample_values"]).where("column_key = 'text'").select("column_key", F.array_join("sample_values", "\n").alias("sample_values"))


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _values(columns, rows):
    def sql(v):
        return f"{v!r}::double" if isinstance(v, float) else repr(v)

    listed = ", ".join(f"({', '.join(map(sql, row))})" for row in rows)
    return f"select * from (values {listed}) t({', '.join(columns)})"


@query(
    "profile_types",
    _values(
        ["column_key", "inferred_type", "confidence", "semantic_role"],
        [
            ("o_orderkey", "number", 0.95, "identifier"),
            ("o_custkey", "number", 0.95, "measure"),
            ("o_orderstatus", "category", 0.95, "dimension"),
            ("o_totalprice", "currency", 0.95, "measure"),
            ("o_orderdate", "date", 1.0, "time"),
            ("o_orderpriority", "category", 0.95, "dimension"),
        ],
    ),
)
def profile_types(spark, sf):
    """Orders read as untyped text."""
    out = P.describe_columns(_as_text(load(spark, sf, "orders")), kinds_by_look=True)
    return out.select("column_key", "inferred_type", "confidence", "semantic_role")


@query(
    "profile_types_typed",
    _values(
        ["column_key", "inferred_type", "semantic_role", "currency_code"],
        [(c, "number", "measure", "") for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]]
        + [("l_extendedprice", "currency", "measure", "USD"), ("l_returnflag", "category", "dimension", ""), ("l_linestatus", "category", "dimension", ""), ("l_shipdate", "date", "time", "")],
    ),
)
def profile_types_typed(spark, sf):
    out = P.describe_columns(load(spark, sf, "lineitem"))
    return out.select("column_key", "inferred_type", "semantic_role", F.coalesce("currency_code", F.lit("")).alias("currency_code"))


@query("profile_roles", "select 'dimension' as semantic_role, 2 as n union all select 'identifier', 1 union all select 'measure', 2 union all select 'time', 1")
def profile_roles(spark, sf):
    return P.describe_columns(load(spark, sf, "orders")).groupBy("semantic_role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recommendations",
    """
    select case when (select count(*) = count(distinct o_orderkey) from orders) then 'o_orderkey' end as primary_key_candidate,
           'o_orderdate' as recommended_time_column, 'o_custkey,o_totalprice' as measures, 'o_orderstatus,o_orderpriority' as dimensions
    """,
)
def recommendations(spark, sf):
    out = P.recommendations(P.describe_columns(load(spark, sf, "orders")))
    return out.select(
        "primary_key_candidate",
        "recommended_time_column",
        F.array_join("recommended_measures", ",").alias("measures"),
        F.array_join("recommended_dimensions", ",").alias("dimensions"),
    )


@query("profile_table")
def profile_table(spark, sf):
    return P.profile_table(load(spark, sf, "lineitem"), F.col("l_orderkey") * 16 + F.col("l_linenumber"))


@query("profile_shareable")
def profile_shareable(spark, sf):
    return P.shareable(P.profile_table(load(spark, sf, "part"), F.col("p_partkey")))


@query(
    "profile_many",
    _counts_sql(["n_nationkey", "n_name", "n_regionkey"], "nation").replace("select ", "select 'nation' as table_name, ")
    + " union all "
    + _counts_sql(["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "supplier").replace("select ", "select 'supplier' as table_name, "),
)
def profile_many(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("nation", "supplier")}
    return P.profile_tables(tables, {"nation": F.col("n_nationkey"), "supplier": F.col("s_suppkey")}).select("table_name", *_COUNTS)


_SUBSET = ["o_custkey", "o_totalprice", "o_orderpriority"]


@query("column_subset", f"select * from ({_counts_sql(_ORDER_COLUMNS, 'orders')}) where column_key in ({', '.join(map(repr, _SUBSET))})")
def column_subset(spark, sf):
    return P.subset(P.describe_columns(load(spark, sf, "orders")), _SUBSET).select(*_COUNTS)


# --- join keys

_OVERLAP = """
select * from (
  with a as (select distinct {a}::varchar as v from {ta}), b as (select distinct {b}::varchar as v from {tb}),
       n as (select (select count(*) from a) as na, (select count(*) from b) as nb, (select count(*) from a join b using (v)) as common)
  select case when common / na >= common / nb then '{na}' else '{nb}' end as source_table,
         case when common / na >= common / nb then '{ca}' else '{cb}' end as source_column,
         case when common / na >= common / nb then '{nb}' else '{na}' end as target_table,
         case when common / na >= common / nb then '{cb}' else '{ca}' end as target_column,
         printf('%.2f', 0.5 + 0.3 * printf('%.4f', common / least(na, nb))::double + {bonus})::double as confidence, printf('%.4f', common / least(na, nb))::double as overlap_ratio
  from n where common / least(na, nb) > 0.5)
"""


@query("join_candidates", _OVERLAP.format(a="o_custkey", ta="orders", b="c_custkey", tb="customer", na="orders", nb="customer", ca="custkey", cb="custkey", bonus=0.2))
def join_candidates(spark, sf):
    tables = {
        "orders": load(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey"),
        "customer": load(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey"),
    }
    return find_join_candidates(tables).drop("sample_matches")


@query(
    "join_candidates_stems",
    " union all ".join(
        [
            _OVERLAP.format(a="l_partkey", ta="lineitem", b="p_partkey", tb="part", na="lineitem", nb="part", ca="part_id", cb="part_key", bonus=0.1),
            _OVERLAP.format(a="l_suppkey", ta="lineitem", b="s_suppkey", tb="supplier", na="lineitem", nb="supplier", ca="supplier", cb="supplier_id", bonus=0.1),
        ]
    ),
)
def join_candidates_stems(spark, sf):
    tables = {
        "lineitem": load(spark, sf, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier"), "l_quantity"),
        "part": load(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), "p_name"),
        "supplier": load(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_name"),
    }
    types = {"lineitem": {"part_id": "id", "supplier": "id", "l_quantity": "number"}, "part": {"part_key": "id", "p_name": "text"}, "supplier": {"supplier_id": "id", "s_name": "text"}}
    return find_join_candidates(tables, types).drop("sample_matches")


_GIVEN_KEYS = {
    "customer": {"customer_key": "c_custkey", "nation_key": "c_nationkey"}, "lineitem": {"order_key": "l_orderkey", "part_key": "l_partkey", "supplier_key": "l_suppkey"},
    "nation": {"nation_key": "n_nationkey", "region_key": "n_regionkey"}, "orders": {"order_key": "o_orderkey", "customer_key": "o_custkey"},
    "part": {"part_key": "p_partkey"}, "region": {"region_key": "r_regionkey"}, "supplier": {"supplier_key": "s_suppkey", "nation_key": "s_nationkey"},
}


def _catalogue_sql():
    parts = [f"select {n} as no, '{t}' as t, '{k}' as k, {c}::varchar as v from \"{t}\"" for n, (t, keys) in enumerate(_GIVEN_KEYS.items()) for k, c in keys.items()]
    return f"""
    with v as (select distinct * from ({" union all ".join(parts)}) where v is not null), n as (select no, t, k, count(*) as n from v group by 1, 2, 3),
    c as (select a.t as ta, b.t as tb, a.k, count(*) as common from v a join v b on a.no < b.no and a.k = b.k and a.v = b.v group by 1, 2, 3),
    r as (select c.*, x.n as na, y.n as nb, printf('%.4f', common / least(x.n, y.n))::double as ratio from c join n x on x.t = ta and x.k = c.k join n y on y.t = tb and y.k = c.k)
    select case when common / na >= common / nb then ta else tb end as source_table, k as source_column, case when common / na >= common / nb then tb else ta end as target_table,
           k as target_column, least(1.0, printf('%.2f', 0.7 + 0.3 * ratio)::double) as confidence, ratio as overlap_ratio
    from r where ratio > 0.5
    """


@query("join_catalogue", _catalogue_sql())
def join_catalogue(spark, sf):
    """All keys of all given tables against each other."""
    tables = {t: load(spark, sf, t).select(*[F.col(c).alias(k) for k, c in keys.items()]) for t, keys in _GIVEN_KEYS.items()}
    types = {t: dict.fromkeys(keys, "id") for t, keys in _GIVEN_KEYS.items()}
    return find_join_candidates(tables, types).drop("sample_matches")


@query(
    "join_candidate_matches",
    """
    select string_agg(v, ',' order by place) as sample_matches from (
      select o_custkey::varchar as v, min(o_orderkey) as place from orders where o_custkey in (select c_custkey from customer)
      group by 1 order by place limit 10)
    """,
)
def join_candidate_matches(spark, sf):
    tables = {
        "orders": load(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey"),
        "customer": load(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey"),
    }
    types = {"orders": dict.fromkeys(tables["orders"].columns, "number"), "customer": dict.fromkeys(tables["customer"].columns, "number")}
    found = find_join_candidates(tables, types, {"orders": "o_orderkey", "customer": "custkey"})
    return found.where("source_column = 'custkey' and target_column = 'custkey'").select(F.array_join("sample_matches", ",").alias("sample_matches"))


@query(
    "numeric_parse",
    """
    select p_partkey, case p_partkey % 6 when 0 then -p_retailprice when 5 then null else round(p_retailprice, 2) end as parsed from part
    """,
)
def numeric_parse(spark, sf):
    """Prices written as accounts do, and as words."""
    price = F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2)
    styles = [F.concat(F.lit("($"), price, F.lit(")")), F.concat(F.lit(" €"), price), F.concat(price, F.lit(" %")), F.concat(F.lit("+"), price), F.concat(F.lit("--"), price), F.concat(F.lit("about "), price)]
    styled = F.get(F.array(*styles), (F.col("p_partkey") % 6).cast("int"))
    return load(spark, sf, "part").select("p_partkey", parse_numeric(styled).alias("parsed"))


# --- automatic reports and questions


def _auto(name, report, sql, **places):
    @query(name, sql)
    def run(spark, sf):
        found = auto_report(load(spark, sf, "orders"), F.col("o_orderkey"))
        return rounded(found[report], **places)


_auto("auto_kpi", "kpi_o_totalprice", "select round(sum(o_totalprice), 2) as o_totalprice from orders", o_totalprice=2)
_auto(
    "auto_donut", "donut_breakdown_o_orderstatus",
    """
    with s as (select o_orderstatus, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1)
    select *, printf('%.1f', o_totalprice / (select sum(o_totalprice) from s) * 100)::double as share from s
    """,
    o_totalprice=2,
)
_auto("auto_breakdown", "bar_breakdown_o_orderstatus", "select o_orderstatus, sum(o_custkey)::bigint as o_custkey from orders group by 1")
_auto("auto_matrix", "pivot_matrix", "select o_orderstatus, o_orderpriority, sum(o_custkey)::bigint as o_custkey from orders group by 1, 2")


@query("auto_trend", "select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as o_orderdate, sum(o_custkey)::bigint as o_custkey from orders group by 1")
def auto_trend(spark, sf):
    found = auto_report(load(spark, sf, "orders"), F.col("o_orderkey"), granularity="month")
    return found["line_trend_o_custkey"].withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "auto_choice",
    _values(
        ["place", "report"],
        list(enumerate(["kpi_o_custkey", "kpi_o_totalprice", "line_trend_o_custkey", "donut_breakdown_o_orderstatus", "bar_breakdown_o_orderstatus", "pivot_matrix", "table_records"])),
    ),
)
def auto_choice(spark, sf):
    profile = P.profile_table(load(spark, sf, "orders"), F.col("o_orderkey"), parts=["top_values"]).collect()
    return spark.createDataFrame([(i, r["id"]) for i, r in enumerate(choose_reports(profile))], "place int, report string")


@query(
    "auto_filters",
    """
    select 'filter_o_orderdate' as filter, 'date-range' as kind, 0 as n_options union all
    select 'filter_o_orderstatus', 'select', least(20, count(distinct o_orderstatus))::int from orders union all
    select 'filter_o_orderpriority', 'select', least(20, count(distinct o_orderpriority))::int from orders
    """,
)
def auto_filters(spark, sf):
    profile = P.profile_table(load(spark, sf, "orders"), F.col("o_orderkey"), parts=["top_values"]).collect()
    rows = [(f["id"], f["kind"], len(f.get("options") or [])) for f in default_filters(profile)]
    return spark.createDataFrame(rows, "filter string, kind string, n_options int")


def _ask(name, question, sql, **places):
    @query(name, sql)
    def run(spark, sf):
        return rounded(ask(load(spark, sf, "orders"), question), **places)


_ask("ask_top", "What are the top 3 o_orderpriority by o_totalprice?", "select o_orderpriority, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1 order by sum(o_totalprice) desc limit 3", o_totalprice=2)
_ask("ask_average", "average o_totalprice", "select round(avg(o_totalprice), 4) as o_totalprice from orders", o_totalprice=4)
_ask("ask_average_by", "average o_totalprice per o_orderstatus", "select o_orderstatus, round(avg(o_totalprice), 4) as o_totalprice from orders group by 1", o_totalprice=4)
_ask("ask_total", "What is the sum of o_totalprice?", "select round(sum(o_totalprice), 2) as o_totalprice from orders", o_totalprice=2)
_ask("ask_total_by", "total o_totalprice by o_orderpriority", "select o_orderpriority, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1", o_totalprice=2)
_ask("ask_count", "How many orders are there for each o_orderstatus?", "select o_orderstatus, count(*) as count_records from orders group by 1")


@query("ask_records", "select least(50, count(*)) as n, 6 as n_columns from orders")
def ask_records(spark, sf):
    out = ask(load(spark, sf, "orders"), "show me some rows")
    return out.agg(F.count(F.lit(1)).alias("n"), F.lit(len(out.columns)).alias("n_columns"))


_ADHOC = """
select r."r_name", count(*) as "count_records", round(sum(o."o_totalprice"), 2) as "total_price"
from "orders" o join "customer" c on o."o_custkey" = c."c_custkey" join "nation" n on c."c_nationkey" = n."n_nationkey"
join "region" r on n."n_regionkey" = r."r_regionkey" where o."o_orderpriority" <> '1-URGENT; DROP' group by r."r_name"
"""


@query("ask_sql", _ADHOC)
def adhoc(spark, sf):
    return ask_sql(spark, _ADHOC, {t: load(spark, sf, t) for t in ("orders", "customer", "nation", "region")})


@query("ask_sql_window", 'select * from (select "o_orderstatus", "o_orderkey", rank() over (partition by "o_orderstatus" order by "o_totalprice" desc) as "val" from "orders") where "val" <= 3')
def adhoc_window(spark, sf):
    return ask_sql(
        spark,
        'SELECT * FROM (SELECT "o_orderstatus", "o_orderkey", rank() OVER (PARTITION BY "o_orderstatus" ORDER BY "o_totalprice" DESC) AS "val" FROM "orders") WHERE "val" <= 3;',
        {"orders": load(spark, sf, "orders")},
    )


_TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events"]


@query("table_row_counts", " union all ".join(f"select {i} as position, '{t}' as name, count(*) as n_rows from {t}" for i, t in enumerate(_TABLES)))
def table_row_counts(spark, sf):
    return row_counts({t: load(spark, sf, t) for t in _TABLES})


@query("active_table", "select 'lineitem' as name, count(*) as n_rows from lineitem")
def active(spark, sf):
    return active_table({t: load(spark, sf, t) for t in _TABLES})
