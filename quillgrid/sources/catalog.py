"""Tables under names: registration, the active table, ingest of files into tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FORBIDDEN_KEYS, KEY_PATTERN, header_key
from ..operators.grid import normalise_grid
from ..session import stored
from .delimited import read_grid


def is_safe_name(name: str) -> bool:
    return len(name) <= 128 and bool(re.match(KEY_PATTERN, name)) and name not in FORBIDDEN_KEYS


def table_name(spark: SparkSession, name: str, table_id: str = "") -> str:
    """The name if it is a safe identifier, else the id, else the name made safe."""
    for candidate in (name, table_id):
        if candidate and is_safe_name(candidate):
            return candidate
    return spark.range(1).select(header_key(F.lit(name), F.lit(0))).first()[0]


def register(df: DataFrame, name: str, table_id: str = "") -> str:
    """Make the table known to SQL under a safe name, replacing an earlier one. A table without columns' types is text."""
    safe = table_name(df.sparkSession, name, table_id)
    df.createOrReplaceTempView(safe)
    return safe


def empty_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    """A table without rows: all columns are text."""
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(position, name, n_rows)`` of several tables in one job."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("position"), F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def active_table(tables: dict[str, DataFrame]) -> DataFrame:
    """The table with the most rows, the first of them on a tie."""
    return row_counts(tables).orderBy(F.desc("n_rows"), "position").limit(1).select("name", "n_rows")


def ingest_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Headers and records of delimited files.

    The parsed grid is written once to the shared folder, since normalising reads it several times; column pruning and
    the filter on the first rows then work on Parquet.
    """
    return normalise_grid(stored(read_grid(spark, paths)))


def same_schema(headers: DataFrame) -> DataFrame:
    """Sheets grouped by their column keys, so that each group can become one table."""
    return headers.groupBy("keys").agg(F.count(F.lit(1)).alias("n_sheets"))


