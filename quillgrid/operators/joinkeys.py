"""Discovery of join keys: columns of different tables whose names, types and values go together."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..functions.text import as_text, normalised
from ..session import stored
from .profile import describe_columns, profile_tables

# Name endings that mark a key, and the least share of common values.
KEY_ENDING = r"(_id|_code|_key|_sku|_ref|_no|_number)$"
LEAST_OVERLAP = 0.5
SAMPLE_MATCHES = 10
SAMPLE_LENGTH = 64
#: Common values that a task sorts to find the first ones, whatever the size of the catalogue.
TASK_VALUES = 250_000


def name_stem(key: str) -> str:
    stem = re.sub(KEY_ENDING, "", key.lower())
    return re.sub(r"^_|_$", "", re.sub(r"^id_", "", stem), count=1)


def names_compatible(a: str, b: str) -> bool:
    """Equal, or one's stem of three letters or more occurs in the other, or a bare ``id`` meets an id-like name."""
    a, b = a.lower(), b.lower()
    stem_a, stem_b = name_stem(a), name_stem(b)
    if a == b or (len(stem_a) >= 3 and stem_a in b) or (len(stem_b) >= 3 and stem_b in a):
        return True
    return any(
        x == "id" and (y.endswith("_id") or y.startswith("id_") or y.endswith("_code")) for x, y in ((a, b), (b, a))
    )


def types_compatible(a: str, b: str) -> bool:
    return a == b or {a, b} == {"id", "text"}


def compatible_names(columns: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of columns of different tables whose names go together, the earlier table's first.

    ``columns`` has ``col``, ``table_no``, ``name`` and ``stem``, one row a column. Names meet through an index of their parts: a
    column asks for its name, its stem and the kinds of names a bare ``id`` goes with, and offers its name and all parts of it, so
    that no two columns are compared that have nothing in common.
    """
    name, size = F.col("name"), F.length("name")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size - 2), lambda at: F.transform(F.sequence(F.lit(3), size - at + 1), lambda n: F.substring(name, at, n))))
    id_like = name.endswith("_id") | name.startswith("id_") | name.endswith("_code")
    none = F.array().cast("array<string>")
    offers = F.concat(F.array(F.concat(F.lit("="), name)), F.transform(F.when(size >= 3, parts).otherwise(none), lambda p: F.concat(F.lit("~"), p)), F.when(id_like, F.array(F.lit("#id"))).otherwise(none))
    asks = F.concat(F.array(F.concat(F.lit("="), name)), F.when(F.length("stem") >= 3, F.array(F.concat(F.lit("~"), "stem"))).otherwise(none), F.when(name == "id", F.array(F.lit("#id"))).otherwise(none))
    offering = columns.select(F.col("col").alias("b"), F.col("table_no").alias("table_b"), F.explode(F.array_distinct(offers)).alias("token"))
    asking = columns.select(F.col("col").alias("a"), F.col("table_no").alias("table_a"), F.explode(asks).alias("token"))
    met = asking.join(offering, "token").where("table_a <> table_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def column_types(df: DataFrame, kinds_by_look: bool = False) -> dict[str, str]:
    return {r["column_key"]: r["inferred_type"] for r in describe_columns(df, kinds_by_look=kinds_by_look).collect()}


def find_join_candidates(
    tables: dict[str, DataFrame],
    types: dict[str, dict[str, str]] | None = None,
    orders: dict[str, str] | None = None,
    max_rows: int | None = None,
    kinds_by_look: bool = False,
) -> DataFrame:
    """Column pairs sharing more than half of the smaller side's distinct values, as source -> target.

    ``types`` spares the inference of column types. ``orders`` names, per table, an integral column that gives the
    place of a row (default: input order); it decides which matches are shown. All rows are compared unless
    ``max_rows`` asks for the first rows only.

    The plan grows with the tables and columns, not with their pairs: names meet in a join, values in one inverted index, and only
    pairs that share rare values are counted (``compatible_names``, ``value_index``). Names of columns pass through the
    driver, values never.
    """
    if max_rows is not None:
        tables = {name: df.limit(max_rows) for name, df in tables.items()}
    schema = "source_table string, source_column string, target_table string, target_column string, confidence double, overlap_ratio double, sample_matches array<string>"
    spark = next(iter(tables.values())).sparkSession
    listed = [(n, table, key) for n, (table, df) in enumerate(tables.items()) for key in df.columns]
    columns = spark.createDataFrame(
        [(col, n, table, key, key.lower(), name_stem(key)) for col, (n, table, key) in enumerate(listed)], "col int, table_no int, table string, key string, name string, stem string"
    )
    named = stored(compatible_names(columns))
    wanted = {listed[c][1] for c in _columns_of(named)}
    if not wanted:
        return spark.createDataFrame([], schema)
    if types is None:
        types = {t: column_types(tables[t], kinds_by_look) for t in wanted}
    kinds = spark.createDataFrame([(col, types[table][key]) for col, (_, table, key) in enumerate(listed) if table in wanted], "col int, kind string")
    kind_of = lambda side: kinds.select(F.col("col").alias(side), F.col("kind").alias(f"kind_{side}"))
    alike = (F.col("kind_a") == F.col("kind_b")) | F.col("kind_a").isin("id", "text") & F.col("kind_b").isin("id", "text")
    pairs = stored(named.join(kind_of("a"), "a").join(kind_of("b"), "b").where(alike).select("a", "b"))
    indexed = _columns_of(pairs)
    if not indexed:
        return spark.createDataFrame([], schema)
    values = value_index(tables, [(col, listed[col][1], listed[col][2]) for col in sorted(indexed)], orders)
    sizes = stored(values.groupBy("col").agg(F.count(F.lit(1)).alias("size")))
    size_of = lambda side: sizes.select(F.col("col").alias(side), F.col("size").alias(f"size_{side}"))
    sized = stored(pairs.join(size_of("a"), "a").join(size_of("b"), "b"))
    # One row a column.
    tasks = 1 + sum(r["size"] for r in sizes.collect()) // TASK_VALUES
    likely = _sharing_rare_values(sized, values, sizes)
    in_a = values.select(F.col("col").alias("a"), "value", F.col("place").alias("place_a"))
    in_b = values.select(F.col("col").alias("b"), "value", F.col("place").alias("place_b"))
    common = stored(in_a.join(F.broadcast(likely), "a").join(in_b, ["b", "value"]))
    found = common.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("common"))
    least = F.least("size_a", "size_b")
    kept = stored(found.withColumn("overlap_ratio", fixed(F.col("common") / least, 4)).where(F.col("overlap_ratio") > LEAST_OVERLAP))
    first_seen = F.when(F.col("size_a") <= F.col("size_b"), F.col("place_a")).otherwise(F.col("place_b"))
    ranked = Window.partitionBy("a", "b").orderBy("seen", "value")
    samples = (
        common.select("a", "b", "value", first_seen.alias("seen"))
        .join(kept, ["a", "b"])
        .repartition(tasks, "value")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= SAMPLE_MATCHES)
        .groupBy("a", "b", "size_a", "size_b", "common", "overlap_ratio")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("value", 1, SAMPLE_LENGTH).alias("value")))).alias("matches"))
    )
    for side in ("a", "b"):
        samples = samples.join(columns.select(F.col("col").alias(side), F.struct("table", "key").alias(f"at_{side}")), side)
    same = F.col("at_a.key") == F.col("at_b.key")
    # The side contained to a larger share refers to the other; the first table on a tie.
    forward = F.col("common") / F.col("size_a") >= F.col("common") / F.col("size_b")
    source, target = (F.when(forward, F.col(x)).otherwise(F.col(y)) for x, y in (("at_a", "at_b"), ("at_b", "at_a")))
    confidence = 0.5 + 0.3 * F.col("overlap_ratio") + F.when(same, 0.2).otherwise(0.1)
    return samples.select(
        source["table"].alias("source_table"),
        source["key"].alias("source_column"),
        target["table"].alias("target_table"),
        target["key"].alias("target_column"),
        F.least(F.lit(1.0), fixed(confidence, 2)).alias("confidence"),
        "overlap_ratio",
        F.transform("matches", lambda m: m["value"]).alias("sample_matches"),
    )


def _columns_of(pairs: DataFrame) -> set[int]:
    """The columns that pairs speak of, at most one row a column."""
    return {r[0] for r in pairs.select(F.explode(F.array("a", "b"))).distinct().collect()}


def value_index(tables: dict[str, DataFrame], columns: list[tuple[int, str, str]], orders: dict[str, str] | None = None) -> DataFrame:
    """Inverted index of a catalogue: ``col, value, place`` (where it is first seen) and ``n_columns``, the columns that hold the value.

    One pass over every table, whatever the number of its columns; values are combined where they are read. ``columns`` lists
    numbers, tables and keys.
    """
    sides = []
    for table, df in tables.items():
        own = [(col, key) for col, of, key in columns if of == table]
        if not own:
            continue
        place = F.col(f"`{orders[table]}`").cast("bigint") if orders and table in orders else F.monotonically_increasing_id()
        cells = [F.struct(F.lit(col).alias("col"), normalised(as_text(F.col(f"`{key}`"), df.schema[key].dataType)).alias("value")) for col, key in own]
        sides.append(df.select(place.alias("place"), F.inline(F.array(*cells))).where(F.col("value").isNotNull()))
    distinct = reduce(DataFrame.unionByName, sides).groupBy("col", "value").agg(F.min("place").alias("place"))
    return stored(distinct.withColumn("n_columns", F.count(F.lit(1)).over(Window.partitionBy("value"))))


def _sharing_rare_values(pairs: DataFrame, values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs that can share more than half of the smaller side's values.

    Of such a pair the common values cannot all lie in the commoner half of the smaller side: among its rarer half (by
    the columns that hold a value) at least one is in the other side. So only that half is looked up, and of it only what any other
    column holds at all. Halves are found from counts by rarity, at most one row for every number of columns. What has one row a column
    or a pair is broadcast: a join by column would bring all values of a column to one task.
    """
    by_rarity = Window.partitionBy("col").orderBy("n_columns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = values.groupBy("col", "n_columns").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(by_rarity))
    rare = counts.join(sizes, "col").where(F.col("upto") >= F.ceil(F.col("size") / 2)).groupBy("col").agg(F.min("n_columns").alias("rarity"))
    first = F.col("size_a") <= F.col("size_b")
    sided = pairs.select("*", F.when(first, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("large"))
    half = values.where("n_columns > 1").join(F.broadcast(rare), "col").where("n_columns <= rarity").select(F.col("col").alias("small"), "value")
    held = values.where("n_columns > 1").select(F.col("col").alias("large"), "value")
    met = half.join(F.broadcast(sided), "small").join(held, ["large", "value"], "left_semi")
    return met.select("a", "b", "size_a", "size_b").distinct()


def profile_workbook(tables: dict[str, DataFrame], orders: dict[str, str] | None = None, kinds_by_look: bool = False) -> tuple[DataFrame, DataFrame]:
    """Profiles of all tables, and the join keys between them; types are taken from the profiles, not inferred again."""
    places = {t: F.col(f"`{c}`") for t, c in (orders or {}).items()}
    profiles = stored(profile_tables(tables, places, kinds_by_look))
    types: dict[str, dict[str, str]] = {t: {} for t in tables}
    # One row a column.
    for r in profiles.select("table_name", "column_key", "inferred_type").collect():
        types[r["table_name"]][r["column_key"]] = r["inferred_type"]
    return profiles, find_join_candidates(tables, types, orders)
