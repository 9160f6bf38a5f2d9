"""Schema drift between versions of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.similarity import edit_distance, name_similarity, token_overlap
from quillgrid.operators import drift as D
from quillgrid.operators.profile import describe_columns
from quillgrid.plans.reports import run_reports

from .base import ORACLE, load, query, rounded
from .profiles import _values

# How the next delivery of orders names its columns; o_orderpriority is gone, a note was added, the key became text.
_NEW_NAMES = {"o_custkey": "custkey", "o_totalprice": "total_price", "o_orderdate": "orderdate"}


def _new_orders(spark, sf):
    df = load(spark, sf, "orders").withColumnsRenamed(_NEW_NAMES).drop("o_orderpriority")
    return df.withColumn("o_orderkey", F.concat(F.lit("K-"), F.col("o_orderkey").cast("string"))).withColumn("remark", F.lit("none"))


def _compared(spark, sf):
    def schema(df):
        # One row per column, kept so that the steps below do not look through the table again.
        rows = D.schema_rows(describe_columns(df), "orders")
        return spark.createDataFrame(rows.collect(), rows.schema)

    return D.compare_schemas(schema(load(spark, sf, "orders")).drop("original_name"), schema(_new_orders(spark, sf)))


_STATUS = [
    ("o_orderkey", "mismatch"), ("o_custkey", "missing"), ("o_orderstatus", "matched"), ("o_totalprice", "missing"), ("o_orderdate", "missing"),
    ("o_orderpriority", "missing"), ("custkey", "added"), ("total_price", "added"), ("orderdate", "added"), ("remark", "added"),
]


@query("drift_compare", _values(["key", "status"], _STATUS))
def drift_compare(spark, sf):
    return _compared(spark, sf).select("key", "status")


@query(
    "drift_renames",
    _values(
        ["missing_key", "suggested_key", "confidence"],
        # 0.4 * edits + 0.5 * words + 0.2 contained, then + 0.2 for the same type, by hand.
        [("o_custkey", "custkey", 0.961), ("o_totalprice", "total_price", 0.667), ("o_orderdate", "orderdate", 0.977)],
    ),
)
def drift_renames(spark, sf):
    return D.suggest_renames(_compared(spark, sf)).select("missing_key", "suggested_key", "confidence")


@query(
    "drift_verdict",
    # One column matches; renames of 0.961 and 0.977 count at nine tenths: (1 + 0.9 * 1.938) / 6.
    _values(["expectation_id", "n_expected", "n_matched", "n_missing", "n_added", "breaking", "overall_confidence"], [("orders", 6, 1, 4, 4, True, 0.457)]),
)
def drift_verdict(spark, sf):
    compared = _compared(spark, sf)
    return D.verdict(compared, D.suggest_renames(compared))


@query("drift_remap", "select o_orderstatus, round(sum(o_totalprice), 2) as o_totalprice from orders group by 1")
def drift_remap(spark, sf):
    """The old report over the new table under its old names."""
    mapping = {old: new for old, new in _NEW_NAMES.items()}
    df = D.rename_columns(_new_orders(spark, sf), mapping)
    report = {"id": "bar", "type": "bar", "dimension": "o_orderstatus", "measures": ["o_totalprice"]}
    return rounded(run_reports(df, [report])["bar"], o_totalprice=2)


@query("drift_remap_reports", "select o_orderstatus, round(sum(o_totalprice), 2) as total_price from orders group by 1")
def drift_remap_reports(spark, sf):
    """The old report rewritten to the new names."""
    report = {"id": "bar", "type": "bar", "dimension": "o_orderstatus", "measures": ["o_totalprice"]}
    return rounded(run_reports(_new_orders(spark, sf), D.remap_reports([report], _NEW_NAMES))["bar"], total_price=2)


_MESSY = """
  select o_orderkey as no, case when o_orderkey % 11 = 0 then 'n/a' when o_orderkey % 5 = 0 then '$' || o_totalprice::decimal(18,2) else o_totalprice::decimal(18,2)::varchar end as paid,
         case when o_orderkey % 13 = 0 then 'soon' when o_orderkey % 17 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as day, o_orderstatus as state, o_custkey % 4 as rush
  from orders
"""


def _messy_orders(spark, sf):
    """Orders as they come from a spreadsheet: text with signs, words among the amounts and dates, under new names."""
    no, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return load(spark, sf, "orders").select(
        no.alias("no"),
        F.when(no % 11 == 0, "n/a").when(no % 5 == 0, F.concat(F.lit("$"), price)).otherwise(price).alias("paid"),
        F.when(no % 13 == 0, "soon").when(no % 17 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.col("o_orderstatus").alias("state"),
        (F.col("o_custkey") % 4).alias("rush"),
    )


_REMAP = {"o_orderkey": "no", "o_totalprice": "paid", "o_orderdate": "day", "o_orderstatus": "state", "rush_order": "rush"}
_KINDS = {"o_orderkey": "id", "o_totalprice": "currency", "o_orderdate": "date", "o_orderstatus": "number", "rush_order": "boolean"}


@query(
    "remap_with_casts",
    f"""
    select no::varchar as o_orderkey, try_cast(replace(paid, '$', '') as double) as o_totalprice, strftime(try_cast(nullif(day, '') as date), '%Y-%m-%d') as o_orderdate,
           state as o_orderstatus, case rush when 0 then false when 1 then true end as rush_order
    from ({_MESSY})
    """,
)
def remap_with_casts(spark, sf):
    """Status is text where a number is expected: it stays as it is."""
    kinds = {"o_totalprice": "currency", "o_orderdate": "date", "o_orderstatus": "text", "rush_order": "number", "o_orderkey": "id"}
    table, _ = D.remap_table(_messy_orders(spark, sf), _REMAP, _KINDS, "no", kinds)
    return table.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "remap_failures",
    f"""
    with m as ({_MESSY})
    select 'o_totalprice' as column_key, 'currency' as expected_type, no::varchar as row_key, paid as value from m where paid = 'n/a' union all
    select 'o_orderdate', 'date', no::varchar, day from m where day = 'soon' union all
    select 'o_orderstatus', 'number', no::varchar, state from m where state <> '' union all
    select 'rush_order', 'boolean', no::varchar, rush::varchar from m where rush not in (0, 1)
    """,
)
def remap_failures(spark, sf):
    _, failures = D.remap_table(_messy_orders(spark, sf), _REMAP, _KINDS, "no")
    return failures


@query(
    "fingerprint",
    """
    select sha256(string_agg(key || ':' || kind || ':' || required, '|' order by key)) as hash, count(*) as column_count from (
      select 'doc_id' as key, 'number' as kind, (count(*) = count(doc_id))::varchar as required from labels union all
      select 'quality', 'number', (count(*) = count(quality))::varchar from labels union all
      select 'toxic', 'number', (count(*) = count(toxic))::varchar from labels)
    """,
)
def fingerprint(spark, sf):
    return D.fingerprint(describe_columns(load(spark, sf, "labels")))


_EXPECTED = [("o_orderdate", "date"), ("o_totalprice", "currency"), ("o_orderstatus", "category"), ("o_orderkey", "text"), ("o_custkey", "number")]


@query(
    "expected_schema",
    " union all ".join(f"select {i} as place, '{k}' as key, '{t}' as type, count({k}) as n_values, count(*) - count({k}) as n_missing from orders" for i, (k, t) in enumerate(_EXPECTED)),
)
def expected_schema(spark, sf):
    """What reports over orders expect, with the values the table has for it."""
    reports = [
        {"type": "kpi", "measure": "o_totalprice", "formats": {"o_totalprice": {"currency": "USD"}}},
        {"type": "bar", "dimension": "o_orderstatus", "measures": ["o_totalprice"]},
        {"type": "table", "columns": ["o_orderkey", "o_orderdate"]},
        {"type": "pivot", "rows": ["o_orderstatus"], "measures": [("o_custkey", "sum")]},
    ]
    found = D.expected_columns(reports, [("date-range", "o_orderdate")])
    orders = load(spark, sf, "orders")
    rows = [
        F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(t).alias("type"), F.count(k).alias("n_values"), F.count_if(F.col(k).isNull()).alias("n_missing"))
        for i, (k, t) in enumerate(found) if k in orders.columns
    ]
    return orders.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("edit_distance", "select p_partkey, levenshtein(p_name, p_type) as distance from part")
def edit_distances(spark, sf):
    return load(spark, sf, "part").select("p_partkey", edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


@query(
    "token_overlap",
    """
    select p_partkey, case when lower(split_part(p_name, ' ', 1)) = lower(p_type) or starts_with(lower(split_part(p_name, ' ', 1)), lower(p_type))
                             or starts_with(lower(p_type), lower(split_part(p_name, ' ', 1)))
                             or lower(split_part(p_name, ' ', 2)) = lower(p_type) or starts_with(lower(split_part(p_name, ' ', 2)), lower(p_type))
                             or starts_with(lower(p_type), lower(split_part(p_name, ' ', 2))) then 0.5 else 0.0 end::double as overlap from part
    """,
)
def token_overlaps(spark, sf):
    """Part names have two words, types one; one match makes 1 of 2."""
    return load(spark, sf, "part").select("p_partkey", token_overlap(F.col("p_name"), F.col("p_type")).alias("overlap"))


@query(
    "name_similarity",
    f"""
    select p_partkey, case when x = y then 1.0 else least(1.0, printf('%.3f', 0.4 * (1 - levenshtein(x, y) / greatest(length(x), length(y))) + 0.5 * overlap
             + case when (length(x) >= 3 and contains(y, x)) or (length(y) >= 3 and contains(x, y)) then 0.2 else 0.0 end)::double) end::double as similarity
    from (select p_partkey, lower(p_name) as x, lower(p_type) as y from part) join ({ORACLE["token_overlap"]}) using (p_partkey)
    """,
)
def name_similarities(spark, sf):
    return load(spark, sf, "part").select("p_partkey", name_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))
