"""Pages of very long ordered tables without sorting or counting them again.

``index_pages`` stores a table once in ranges of its order and counts each range. A page then needs the ranges that
hold it only, usually one, whatever its number; running totals of the counts say which.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import orders_of, page_of
from ..session import shared_folder

#: Rows of a range; what a page reads and sorts is one range or two.
RANGE_ROWS = 1 << 18


@dataclass
class PageIndex:
    """A stored table, the column that numbers its ranges, the rows of each range, and its order."""

    rows: DataFrame
    part: str
    counts: dict[int, int]
    keys: list[tuple[str, str]]
    ties: list[str]

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def pages(self, size: int = 10) -> int:
        return max(1, -(-self.total // size))

    def rows_from(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order."""
        if offset < 0:
            raise ValueError("offset is not negative")
        before = [0, *accumulate(n for _, n in sorted(self.counts.items()))]
        hit = [(part, at) for (part, n), at in zip(sorted(self.counts.items()), before) if at < offset + limit and at + n > offset]
        held = self.rows.where(F.col(f"`{self.part}`").isin([part for part, _ in hit]))
        ordered = held.orderBy(*_total_order(held.drop(self.part), self.keys, self.ties))
        return page_of(ordered, limit, offset - hit[0][1] if hit else 0).drop(self.part)

    def page(self, number: int, size: int = 10) -> DataFrame:
        """A page; a number past the end gives the last one."""
        number = min(max(1, number), self.pages(size))
        return self.rows_from((number - 1) * size, size)


def _total_order(df: DataFrame, keys: list[tuple[str, str]], ties: list[str]) -> list:
    """The order with a hash of the row at its end, so that rows alike in all keys have their places too."""
    return [*orders_of(df, keys, ties), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()])]


def index_pages(df: DataFrame, keys: Iterable[tuple[str, str]] = (), ties: Iterable[str] = (), range_rows: int = RANGE_ROWS) -> PageIndex:
    """Store the table in ranges of ``(column, "asc" | "desc")`` keys, then ``ties``, as ``order_by`` orders them.

    One shuffle by range. Rows alike in all keys are spread by a hash of the row, so no range holds a hot key alone. The driver learns one
    number a range.
    """
    spark, keys, ties = df.sparkSession, list(keys), list(ties)
    part = "page_range"
    while part in df.columns:
        part += "_"
    ranges = max(1, -(-df.count() // range_rows))
    placed = df.repartitionByRange(ranges, *_total_order(df, keys, ties)).withColumn(part, F.spark_partition_id())
    folder = shared_folder(spark)
    placed.write.partitionBy(part).parquet(folder)
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])
    rows = spark.read.schema(schema).parquet(folder)
    counts = {r[part]: r["count"] for r in rows.groupBy(part).count().collect()}
    return PageIndex(rows, part, counts, keys, ties)
