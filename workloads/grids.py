"""Messy grids made from the given tables, and the tables found in them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.functions.dates import date_text, parse_date, serial_date
from quillgrid.functions.text import header_key, neutralise, unique_keys
from quillgrid.operators import grid as G
from quillgrid.session import stored
from quillgrid.sources.audit import audit_bounds
from quillgrid.sources.delimited import grid_cells, grid_from_cells

from .base import document_lines, load, order_sheets, query

_SHEETS = "(select distinct 'customer-' || o_custkey as file_id, o_custkey from orders)"
_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279) || chr(8232) || chr(8233) || chr(12288)"


@query(
    "header_detect",
    f"""
    select file_id, 2 as header_row, 'Order Key|orderStatus|Price Paid|Order Date' as original_headers,
           'order_key|order_status|price_paid|order_date' as keys from {_SHEETS}
    """,
)
def header_detect(spark, sf):
    out = G.detect_headers(order_sheets(spark, sf))
    return out.select("file_id", "header_row", F.array_join("original_headers", "|").alias("original_headers"), F.array_join("keys", "|").alias("keys"))


@query(
    "grid_table",
    """
    select 'customer-' || o_custkey as file_id, o_orderkey::varchar as order_key, o_orderstatus as order_status,
           cast(o_totalprice as decimal(18,2))::varchar as price_paid, strftime(o_orderdate, '%Y-%m-%d') as order_date from orders
    """,
)
def grid_table(spark, sf):
    """Title, blank, total and note rows go; the orders come back as they were."""
    _, records = G.normalise_grid(stored(order_sheets(spark, sf)))
    return G.to_table(records, ["order_key", "order_status", "price_paid", "order_date"]).drop("sheet", "row_idx")


@query(
    "grid_through_cells",
    "select o_custkey, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by o_custkey",
)
def grid_through_cells(spark, sf):
    """The same sheets handed over cell by cell."""
    _, records = G.normalise_grid(stored(grid_from_cells(grid_cells(order_sheets(spark, sf)))))
    found = G.to_table(records, ["order_key"]).select(F.substring_index("file_id", "-", -1).cast("bigint").alias("o_custkey"), F.col("order_key").cast("bigint").alias("k"))
    return found.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


def _order_line_sheets(spark, sf):
    """Lines by order; the order key stands only in the first line of the order, merged down over its lines."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    # An order's few lines are numbered inside it.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = lines.withColumn("row_idx", place.cast("bigint"))
    sheet = [F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("file_id"), F.lit("lines").alias("sheet")]
    # The last row is the number of lines, which is counted without numbering them again.
    orders = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("end_row"))
    merges = orders.select(*sheet, F.lit(0).alias("merge_idx"), F.lit(1).cast("bigint").alias("start_row"), F.lit(0).alias("start_col"), "end_row", F.lit(0).alias("end_col"))

    def cell(c, kind="number"):
        return F.struct(c.alias("raw"), F.when(c.isNull(), F.lit(None).cast("string")).otherwise(kind).alias("kind"))

    key = F.when(F.col("row_idx") == 1, F.col("l_orderkey").cast("string"))
    rows = lines.select(*sheet, "row_idx", F.array(cell(key), cell(F.col("l_partkey").cast("string")), cell(F.col("l_linenumber").cast("string"))).alias("cells"))
    head = F.array(*[cell(F.lit(h), "string") for h in ("Order Key", "Part Key", "Line")]).alias("cells")
    return orders.select(*sheet, F.lit(0).cast("bigint").alias("row_idx"), head).unionByName(rows), merges


@query("merge_fill", "select 'order-' || l_orderkey as file_id, l_orderkey::varchar as order_key, l_partkey::varchar as part_key, l_linenumber::varchar as line from lineitem")
def merge_fill(spark, sf):
    grid, merges = _order_line_sheets(spark, sf)
    _, records = G.normalise_grid(stored(G.fill_merges(stored(grid), stored(merges))))
    return G.to_table(records, ["order_key", "part_key", "line"]).drop("sheet", "row_idx")


_LINES = f"""
(select doc_id, row_idx, trim(line, {_SPACE}) as t, max(row_idx) over (partition by doc_id) as last from
  (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as row_idx from documents))
"""
_SUBTOTAL = r"(length(t) < 60 and regexp_matches(t, '(?i)(?:^|\s)(?:total|subtotal|sub-total|grand\s*total|sum|average|avg)\b'))"
_NOTE = r"regexp_matches(t, '(?i)^\s*(?:\*|note[s]?:|source:|confidential|copyright|unaudited|disclaimer:)')"


@query("line_flags", f"select doc_id, row_idx, t = '' as is_blank, (t <> '' and {_SUBTOTAL}) as is_subtotal, (t <> '' and {_NOTE}) as is_footnote from {_LINES}")
def line_flags(spark, sf):
    flagged = G.row_flags(document_lines(spark, sf), F.lit(1))
    return flagged.select(F.col("file_id").cast("bigint").alias("doc_id"), "row_idx", "is_blank", "is_subtotal", "is_footnote")


@query(
    "lines_noise",
    f"""
    with flagged as (select *, t = '' as is_blank, (t <> '' and {_SUBTOTAL}) as is_subtotal, (t <> '' and {_NOTE}) as is_note from {_LINES}),
         ends as (select doc_id, max(row_idx) as last_row from flagged where not is_blank and not is_note group by doc_id)
    select doc_id, count(*) as n_rows, sum(row_idx)::bigint as row_sum, sum(length(t))::bigint as n_chars
    from flagged join ends using (doc_id) where row_idx <= last_row and not is_blank and not is_subtotal group by doc_id
    """,
)
def lines_noise(spark, sf):
    """Whole documents as one-column sheets that have no header row of their own: what is left of all their lines."""
    grid = document_lines(spark, sf)
    headers = grid.select("file_id", "sheet").distinct().select(
        "*", F.lit(-1).cast("bigint").alias("header_row"), F.array(F.lit("line")).alias("keys"), F.array(F.lit(0)).alias("active_columns")
    )
    kept = G.to_table(G.records(grid, headers), ["line"])
    return kept.groupBy(F.col("file_id").cast("bigint").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("row_idx").alias("row_sum"), F.sum(F.length("line")).alias("n_chars")
    )


@query("document_headers")
def document_headers(spark, sf):
    """Header detection over the lines of every document, cut into words."""
    lines = document_lines(spark, sf)
    words = F.filter(F.split(F.col("cells")[0]["raw"], "[ ,.]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.struct(w.alias("raw"), F.when(w.rlike("^[0-9]+$"), "number").otherwise("string").alias("kind")))
    return G.detect_headers(lines.withColumn("cells", cells))


@query("bounds_audit", f"select doc_id, max(row_idx) + 1 as n_rows, 1 as n_columns, 1 as n_sheets, max(row_idx) + 1 > 200000 as too_many_rows from {_LINES} group by doc_id")
def bounds_audit(spark, sf):
    out = audit_bounds(document_lines(spark, sf))
    return out.select(F.col("file_id").cast("bigint").alias("doc_id"), "n_rows", "n_columns", "n_sheets", "too_many_rows")


_KEY = r"""
case when k in ('', '_') then 'col_1' else k end as key from (select page_id, regexp_replace(k, '^(.+)_$', '\1') as k from
(select page_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')), '^([0-9])', '_\1') as k from pages))
"""


@query("header_keys", f"select page_id, left(key, 120) as key from (select page_id, {_KEY})")
def header_keys(spark, sf):
    return load(spark, sf, "pages").select("page_id", header_key(F.col("url"), F.lit(0)).alias("key"))


@query("unique_keys", "select o_orderkey, 'a' as k0, case when o_orderstatus = 'F' then 'a_1' else 'b' end as k1, case when o_orderstatus = 'F' then 'a_2' else 'a_1' end as k2 from orders")
def unique_key_arrays(spark, sf):
    second = F.when(F.col("o_orderstatus") == "F", "a_1").otherwise("b")
    keys = unique_keys(F.array(F.lit("a"), second, F.lit("a")))
    return load(spark, sf, "orders").select("o_orderkey", *[F.get(keys, i).alias(f"k{i}") for i in range(3)])


@query("neutralise", "select doc_id, line, case when left(trim(line, " + _SPACE + "), 1) in ('=', '+', '-', '@', '|') then '''' || line else line end as safe from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)")
def neutralised_lines(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", "line", neutralise(F.col("line")).alias("safe"))


@query("serial_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day_1900, strftime(o_orderdate, '%Y-%m-%d') as day_1904 from orders")
def serial_dates(spark, sf):
    """Order dates as the day numbers of both spreadsheet systems, with a time of day, and back."""
    days = [F.date_diff("o_orderdate", F.lit(base)).cast("double") + 0.75 for base in ("1899-12-30", "1904-01-01")]
    return load(spark, sf, "orders").select("o_orderkey", date_text(serial_date(days[0])).alias("day_1900"), date_text(serial_date(days[1], 1904)).alias("day_1904"))


@query("parse_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def parse_dates(spark, sf):
    """Order dates written in six styles, and back."""
    styles = ["yyyy-MM-dd", "yyyy/M/d", "MM/dd/yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "MMM d yyyy"]
    written = F.get(F.array(*[F.date_format("o_orderdate", s) for s in styles]), (F.col("o_orderkey") % 6).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", date_text(parse_date(written)).alias("day"))
