"""What the registered queries share: the registry, table loading, rounding, and tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows where SQL can say it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Sums of doubles depend on their order; amounts have two decimals, so rounding makes them comparable."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), n) for c, n in places.items()})


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where there are none."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(load(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = "(select doc_id, lang, source, n_chars, quality, toxic from documents left join labels using (doc_id))"


def _cells(*values):
    def cell(v):
        kind = F.when(v.isNull(), F.lit(None).cast("string")).when(v.rlike(r"^[+-]?[0-9]+\.?[0-9]*$"), "number").otherwise("string")
        return F.struct(v.alias("raw"), kind.alias("kind"))

    return F.array(*[cell(v.cast("string")) for v in values])


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out as messy sheets, one per customer: title, blank row, header, orders, total and a note.

    Row numbers follow the order keys and leave gaps, so that no customer's orders are brought together to be numbered.
    """
    orders = load(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    data = orders.select(
        F.col("o_custkey").alias("c"),
        (F.col("o_orderkey") + 3).cast("bigint").alias("row_idx"),
        _cells(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells"),
    )
    sheets = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_orderkey").alias("last"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    lines = [
        (F.lit(0), F.concat(F.lit("Orders of customer "), F.col("c").cast("string")), none, none, none),
        (F.lit(1), none, F.lit("  "), none, none),
        (F.lit(2), F.lit("Order Key"), F.lit("orderStatus"), F.lit(" Price Paid "), F.lit("Order Date")),
        (F.col("last") + 4, F.lit("Total"), none, F.col("total"), none),
        (F.col("last") + 5, F.lit("* Unaudited figures"), none, none, none),
    ]
    rows = F.array(*[F.struct(at.cast("bigint").alias("row_idx"), _cells(*values).alias("cells")) for at, *values in lines])
    frame = sheets.select("c", F.inline(rows))
    return data.unionByName(frame).select(F.concat(F.lit("customer-"), F.col("c").cast("string")).alias("file_id"), F.lit("orders").alias("sheet"), "row_idx", "cells")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sheets of one column, a row per line."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
    cells = F.array(F.struct(F.col("line").alias("raw"), F.lit("string").alias("kind")))
    return lines.select(F.col("doc_id").cast("string").alias("file_id"), F.lit("text").alias("sheet"), F.col("row_idx").cast("bigint").alias("row_idx"), cells.alias("cells"))
