"""Column profiles: logical type, role, counts, numeric statistics, top values, samples, key candidate.

A profile starts from ``value_counts``: every distinct value of every column with its frequency and the place it was
first seen. That is the one shuffle over the data; it combines on the map side, so a value that fills a third of the
rows arrives as one row per task. Everything else reads that table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.numbers import CURRENCY_SIGNS, NUMBER_TEXT, coerced_number, finite, fixed, is_finite_number, is_numeric, parse_numeric
from ..functions.text import as_text, category_label, normalised, plain_number, sample_label, trimmed
from .median import by_ordinal, lower_medians

# Lengths of the value lists of a profile.
TOP_VALUES = 50
SAMPLES = 5
FEW_DISTINCT = 50
NUMERIC_KINDS = ["number", "currency", "percent"]


@dataclass(frozen=True)
class ProfiledColumn:
    """What is known of a column before its data is read."""

    ordinal: int
    key: str
    original_name: str
    slot: str  # lng, dbl or txt: the type its values are counted in
    kind: str  # number, date, timestamp or other


def profiled_columns(df: DataFrame, original_names: dict[str, str] | None = None) -> list[ProfiledColumn]:
    names = original_names or {}
    out = []
    for i, f in enumerate(df.schema.fields):
        dtype, slot, kind = f.dataType, "txt", "number" if is_numeric(f.dataType) else "other"
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            slot, kind = "lng", "date" if isinstance(dtype, T.DateType) else "timestamp"
        elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            slot = "lng"
        elif isinstance(dtype, (T.FloatType, T.DoubleType)) or (isinstance(dtype, T.DecimalType) and dtype.precision <= 15):
            slot = "dbl"
        original = names.get(f.name) or (f.metadata or {}).get("originalName") or f.name
        out.append(ProfiledColumn(i, f.name, original, slot, kind))
    return out


def value_counts(df: DataFrame, order: Column | None = None) -> DataFrame:
    """``(ordinal, lng, dbl, txt, n, first_seen)``: the distinct values of every column.

    Integers, doubles and text are counted in columns of their own type, so numbers and times are never turned into text
    to be grouped. ``order`` is an integral expression giving the row's place (default: input order); an integral one keeps
    the aggregate hash based.
    """
    empty = {"lng": "bigint", "dbl": "double", "txt": "string"}
    slots, groups = [], []
    for col in profiled_columns(df):
        c, dtype = F.col(f"`{col.key}`"), df.schema[col.key].dataType
        cells = {slot: F.lit(None).cast(kind) for slot, kind in empty.items()}
        if col.kind == "timestamp":
            cells["lng"] = F.unix_micros(c.cast("timestamp"))
        elif col.kind == "date":
            cells["lng"] = F.unix_date(c).cast("bigint")
        elif col.slot == "lng":
            cells["lng"] = c.cast("bigint")
        elif col.slot == "dbl":
            cells["dbl"] = finite(c.cast("double"))
        else:
            cells["txt"] = normalised(as_text(c, dtype))
        slots += [cell.alias(f"{slot}{col.ordinal}") for slot, cell in cells.items()]
        groups.append(f"(lng{col.ordinal}, dbl{col.ordinal}, txt{col.ordinal}) as `{col.ordinal}`")
    place = (F.monotonically_increasing_id() if order is None else order).cast("bigint").alias("place")
    long = df.sparkSession.sql(
        f"select * from {{cells}} unpivot include nulls ((lng, dbl, txt) for ordinal in ({', '.join(groups)}))",
        cells=df.select(place, *slots),
    )
    return (
        long.groupBy("ordinal", "lng", "dbl", "txt")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_seen"))
        .withColumn("ordinal", F.col("ordinal").cast("int"))
    )


def _by_ordinal(values: Iterable) -> Column:
    """A constant looked up by column ordinal, in place of a join with a list of columns."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("ordinal"))


def _has(name: Column, words: list[str]) -> Column:
    return name.rlike(V.any_of(words))


def value_text(columns: list[ProfiledColumn]) -> Column:
    """The value of a ``value_counts`` row as text, whichever slot holds it."""
    shown = as_text(F.timestamp_micros("lng"), T.TimestampType())
    day = as_text(F.date_from_unix_date(F.col("lng").cast("int")), T.DateType())
    kind = _by_ordinal([c.kind for c in columns])
    times = F.when(kind == "timestamp", shown).when(kind == "date", day).otherwise(F.col("lng").cast("string"))
    return F.coalesce(F.col("txt"), F.when(F.col("lng").isNotNull(), times), plain_number(F.col("dbl")))


def _currency_index(t: Column) -> Column:
    """1-based place of the currency a text names, over signs first and codes after; null when it names none."""
    signs = list(V.CURRENCY_OF_SIGN)
    code = F.upper(F.regexp_extract(t, V.CURRENCY_CODE_WORD, 1))
    by_code = F.nullif(F.array_position(F.array(*[F.lit(c) for c in V.CURRENCY_CODES]), code), F.lit(0)) + len(signs)
    found = F.when(t.contains(signs[0]), F.lit(1))
    for i, sign in enumerate(signs[1:], start=2):
        found = found.when(t.contains(sign), F.lit(i))
    return found.otherwise(by_code).cast("int")


def _counters(counts: DataFrame, columns: list[ProfiledColumn], kinds_by_look: bool) -> DataFrame:
    """One row per column with everything the type rules ask of the values. Patterns run once per distinct value."""
    # A column of a table without rows still gets its row: one missing cell that counts for nothing.
    unseen = counts.sparkSession.range(len(columns)).select(
        F.col("id").cast("int").alias("ordinal"),
        *[F.lit(None).cast(kind).alias(slot) for slot, kind in (("lng", "bigint"), ("dbl", "double"), ("txt", "string"))],
        F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("bigint").alias("first_seen"),
    )
    counts = counts.unionByName(unseen)
    t, kind = F.col("txt"), _by_ordinal([c.kind for c in columns])
    timed = kind.isin("date", "timestamp") & F.col("lng").isNotNull()
    number = F.coalesce(F.when(kind == "number", F.col("lng").cast("double")), F.col("dbl"))
    looks = t.rlike(NUMBER_TEXT) if kinds_by_look else F.lit(False)
    marked = counts.select(
        "ordinal", "txt", "n", "first_seen",
        number.alias("number"),
        timed.alias("timed"),
        (t.isNotNull() & ((kind == "number") | looks)).alias("number_text"),
        F.coalesce(number, finite(coerced_number(t))).alias("plain_value"),
        F.coalesce(number, parse_numeric(t)).alias("value"),
        trimmed(F.translate(t, CURRENCY_SIGNS + ",", "")).alias("unsigned_text"),
        trimmed(F.regexp_replace(t, r"^([^%]*)%", "$1")).alias("no_percent"),
    )
    numeric_cell = F.col("number").isNotNull()
    text_kind = t.isNotNull() & ~F.col("number_text")
    truth = t.isin(V.TRUTH_WORDS) | (t.isin("TRUE", "FALSE") if kinds_by_look else F.lit(False))
    zero_one = F.col("plain_value").isin(0.0, 1.0) & (numeric_cell | F.col("number_text"))
    money_number = numeric_cell | is_finite_number(F.col("unsigned_text"))
    percent_number = numeric_cell | is_finite_number(F.col("no_percent"))
    code_part = t.rlike(V.CODE_PART) | (t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    currency = F.when(text_kind, _currency_index(t))

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    value, n = F.col("value"), F.col("n")
    filled = t.isNotNull() | numeric_cell | F.col("timed")
    return marked.groupBy("ordinal").agg(
        F.sum("n").alias("total_count"),
        rows(filled).alias("n_filled"),
        F.count_if(filled).alias("distinct_count"),
        rows(truth).alias("n_truth"),
        rows(zero_one | t.isin(V.BINARY_WORDS)).alias("n_binary"),
        rows(text_kind & t.rlike(V.PERCENT_CELL)).alias("n_percent"),
        rows(percent_number).alias("n_percent_number"),
        rows(F.col("timed") | t.rlike(V.ISO_DATE_CELL) | t.rlike(V.OTHER_DATE_CELL)).alias("n_date"),
        rows(F.col("plain_value").between(23000, 65000)).alias("n_serial"),
        rows(text_kind & t.rlike(V.CURRENCY_CELL)).alias("n_currency"),
        rows(money_number).alias("n_numeric"),
        rows(text_kind & t.rlike(V.CODE_CELL)).alias("n_code"),
        rows(text_kind & code_part).alias("n_code_part"),
        F.min_by(currency, F.when(currency.isNotNull(), F.col("first_seen"))).alias("currency_index"),
        rows(value.isNotNull()).alias("n_values"),
        F.sum(value * n).alias("value_sum"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
    )


def _type_rules(name: Column, key: Column) -> Column:
    """The first rule that holds gives type, confidence and format. ``name`` is original name and key in lower case."""
    filled = F.col("n_filled")

    def share(counter: str) -> Column:
        return F.try_divide(F.col(counter), filled)

    def graded(counter: str) -> Column:
        return F.least(F.lit(1.0), 0.85 + 0.15 * share(counter))

    uniqueness = F.try_divide(F.col("distinct_count"), filled)
    numeric = F.col("n_numeric") == filled
    identifier = _has(name, V.IDENTIFIER)
    flag = name.contains("flag") | name.startswith("is_") | name.startswith("has_") | name.endswith("_met")
    planned = name.contains("planned") & ~_has(name, ["budget", "cost", "unit"])
    serial = (_has(name, V.SERIAL_DATE) | planned) & ~_has(name, V.MONEY) & ~_has(name, V.NOT_MONEY)
    empty = filled == 0
    none = F.lit(None).cast("string")
    # Format patterns and confidences of the rules.
    percent_format, date_format, money_format = F.lit("0.0%"), F.lit("YYYY-MM-DD"), F.lit("$#,##0.00")
    rules = [
        (empty & _has(name, V.PERCENT_IF_EMPTY), "percent", 0.85, none),
        (empty & _has(name, V.DATE_IF_EMPTY), "date", 0.85, none),
        (empty & _has(name, V.MONEY_IF_EMPTY), "currency", 0.85, none),
        (empty & identifier, "id", 0.85, none),
        (empty, "text", 0.5, none),
        (F.col("n_truth") == filled, "boolean", 1.0, none),
        (flag & (F.col("n_binary") == filled), "boolean", 0.95, none),
        (share("n_percent") >= 0.8, "percent", graded("n_percent"), percent_format),
        (_has(name, V.PERCENT) & (F.col("n_percent_number") == filled), "percent", 0.95, percent_format),
        (share("n_date") >= 0.8, "date", graded("n_date"), date_format),
        (serial & (share("n_serial") >= 0.8), "date", 0.95, date_format),
        (share("n_currency") >= 0.8, "currency", graded("n_currency"), money_format),
        (numeric & ~_has(name, V.NOT_MONEY) & _has(name, V.MONEY), "currency", 0.95, money_format),
        (numeric & _has(name, V.NUMERIC_ID), "id", 0.9, none),
        (numeric, "number", 0.95, none),
        (name.contains("expense_category"), "text", 0.9, none),
        (_has(name, V.CATEGORY), "category", 0.95, none),
        (_has(name, V.FREE_TEXT), "text", 0.9, none),
        (identifier & ((uniqueness >= 0.8) | (F.col("n_code") == filled)), "id", 0.95, none),
        ((uniqueness >= 0.9) & (F.col("n_code_part") > 0), "id", 0.9, none),
        (key.isin("col_2", "col_3"), "text", 0.8, none),
        ((F.col("distinct_count") <= FEW_DISTINCT) | (uniqueness <= 0.2), "category", 0.85, none),
        (F.lit(True), "text", 0.8, none),
    ]
    chain = F
    for test, kind, confidence, pattern in rules:
        sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
        result = F.struct(F.lit(kind).alias("kind"), sure.cast("double").alias("confidence"), pattern.alias("pattern"))
        chain = chain.when(test, result)
    return chain


def _role(name: Column, key: Column, kind: Column) -> Column:
    duration = _has(name, V.DURATION_ROLE)
    timed = _has(name, V.TIME_ROLE) | F.lower(key).endswith("_at") | F.lower(key).endswith("_on")
    unique_id = (F.col("uniqueness_ratio") >= 0.95) & (F.col("total_count") >= 3) & _has(name, V.IDENTIFIER_ROLE)
    return (
        F.when(((kind == "date") | timed) & ~duration, "time")
        .when((kind == "id") | unique_id, "identifier")
        .when(kind.isin(NUMERIC_KINDS) & ~timed, "measure")
        .otherwise("dimension")
    )


def column_facts(counts: DataFrame, columns: list[ProfiledColumn], kinds_by_look: bool = False) -> DataFrame:
    """One row per column: type, confidence, currency, format, role and counts, plus sums the statistics build on."""
    key, original = _by_ordinal([c.key for c in columns]), _by_ordinal([c.original_name for c in columns])
    counted = _counters(counts, columns, kinds_by_look).select("*", key.alias("column_key"), original.alias("original_name"))
    name = F.lower(F.concat_ws(" ", "original_name", "column_key"))
    ratio = F.coalesce(fixed(F.try_divide(F.col("distinct_count"), F.col("total_count")), 4), F.lit(0.0))
    typed = counted.withColumn("rule", _type_rules(name, F.col("column_key"))).withColumn("uniqueness_ratio", ratio)
    named_code = F.nullif(F.upper(F.regexp_extract(name, V.CURRENCY_CODE_WORD, 1)), F.lit(""))
    all_codes = [*V.CURRENCY_OF_SIGN.values(), *V.CURRENCY_CODES]
    first_code = F.get(F.array(*[F.lit(c) for c in all_codes]), F.col("currency_index") - 1)
    kind = F.col("rule.kind")
    return typed.select(
        "ordinal",
        "column_key",
        "original_name",
        kind.alias("inferred_type"),
        F.col("rule.confidence").alias("confidence"),
        F.when(kind == "currency", F.coalesce(named_code, first_code, F.lit("USD"))).alias("currency_code"),
        F.col("rule.pattern").alias("format_pattern"),
        _role(name, F.col("column_key"), kind).alias("semantic_role"),
        (F.col("total_count") > F.col("n_filled")).alias("nullable"),
        (F.col("total_count") - F.col("n_filled")).alias("null_count"),
        "total_count",
        "distinct_count",
        "uniqueness_ratio",
        "n_values",
        "value_sum",
        "value_min",
        "value_max",
    )


def describe_columns(df: DataFrame, order: Column | None = None, original_names: dict[str, str] | None = None, kinds_by_look: bool = False) -> DataFrame:
    """Types, roles and counts of every column of a table."""
    return column_facts(value_counts(df, order), profiled_columns(df, original_names), kinds_by_look)


def numeric_stats(counts: DataFrame, facts: list[Row]) -> dict[int, tuple]:
    """Least, greatest, sum, mean, exact median, population variance and deviation of number, currency and percent columns.

    The variance is taken around the mean in a second pass over the distinct values, not from sums of squares.
    """
    numeric = {f["ordinal"]: f for f in facts if f["inferred_type"] in NUMERIC_KINDS and f["n_values"] > 0}
    if not numeric:
        return {}
    value = F.coalesce(F.col("lng").cast("double"), F.col("dbl"), parse_numeric(F.col("txt")))
    values = counts.where(F.col("ordinal").isin(list(numeric))).select("ordinal", value.alias("v"), "n").where(F.col("v").isNotNull())
    middles = lower_medians(values)
    mean = by_ordinal({o: f["value_sum"] / f["n_values"] for o, f in numeric.items()})
    lower = by_ordinal({o: m for o, (m, _) in middles.items()})
    v, n = F.col("v"), F.col("n")
    around = values.groupBy("ordinal").agg(
        F.sum(n * F.pow(v - mean, 2)).alias("squares"),
        F.sum(F.when(v <= lower, n)).alias("upto"),
        F.min(F.when(v > lower, v)).alias("next"),
    )
    out = {}
    for r in around.collect():
        f, (middle, total) = numeric[r["ordinal"]], middles[r["ordinal"]]
        # With an even count the upper middle is the same value when it repeats past the middle, else the next one.
        upper = middle if total % 2 == 1 or r["upto"] > total / 2 else r["next"]
        variance = r["squares"] / f["n_values"]
        mean_value = f["value_sum"] / f["n_values"]
        out[r["ordinal"]] = (f["value_min"], f["value_max"], f["value_sum"], mean_value, (middle + upper) / 2, variance, math.sqrt(variance))
    return out


def top_values(counts: DataFrame, columns: list[ProfiledColumn], facts: list[Row]) -> DataFrame:
    """Up to 50 most frequent values of category, boolean and few-valued columns, ties by first appearance."""
    wanted = [f["ordinal"] for f in facts if f["inferred_type"] in ("category", "boolean") or f["distinct_count"] <= FEW_DISTINCT]
    ranked = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("first_seen"))
    share = F.least(F.lit(100.0), fixed(F.col("n") / F.lit(max(1, facts[0]["total_count"])) * 100, 2))
    # Spark keeps the first 50 rows of a column in every task before it shuffles for the ranking.
    return (
        counts.where(F.col("ordinal").isin(wanted))
        .withColumn("value", value_text(columns))
        .where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= TOP_VALUES)
        .select("ordinal", "rank", category_label(F.col("value")).alias("value"), F.col("n").alias("count"), share.alias("percentage"))
    )


def sample_values(counts: DataFrame, columns: list[ProfiledColumn]) -> DataFrame:
    """The first five different shown values of each column."""
    ranked = Window.partitionBy("ordinal").orderBy("first_seen")
    return (
        counts.withColumn("text", value_text(columns))
        .where(F.col("text").isNotNull())
        .groupBy("ordinal", sample_label(F.col("text")).alias("value"))
        .agg(F.min("first_seen").alias("first_seen"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= SAMPLES)
        .select("ordinal", "rank", "value")
    )


PROFILE_SCHEMA = """
ordinal int, column_key string, original_name string, inferred_type string, confidence double, currency_code string,
format_pattern string, semantic_role string, nullable boolean, null_count bigint, total_count bigint,
distinct_count bigint, uniqueness_ratio double,
stats struct<min: double, max: double, sum: double, mean: double, median: double, variance: double, std_dev: double>,
top_values array<struct<value: string, count: bigint, percentage: double>>, sample_values array<string>
"""


def profile_table(
    df: DataFrame,
    order: Column | None = None,
    original_names: dict[str, str] | None = None,
    kinds_by_look: bool = False,
    parts: Iterable[str] = ("stats", "top_values", "sample_values"),
) -> DataFrame:
    """The profile of a table, one row per column in column order.

    The distinct values are counted once and kept on the executors while the parts read them; a lost executor's share
    is counted again. What reaches the driver is one row per column, and at most 50 top values and 5 samples of each.
    """
    parts = set(parts)
    columns = profiled_columns(df, original_names)
    counts = value_counts(df, order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = column_facts(counts, columns, kinds_by_look).collect()
        stats = numeric_stats(counts, facts) if "stats" in parts else {}
        tops: dict[int, list] = {}
        samples: dict[int, list] = {}
        if "top_values" in parts:
            for r in top_values(counts, columns, facts).orderBy("ordinal", "rank").collect():
                tops.setdefault(r["ordinal"], []).append((r["value"], r["count"], r["percentage"]))
        if "sample_values" in parts:
            for r in sample_values(counts, columns).orderBy("ordinal", "rank").collect():
                samples.setdefault(r["ordinal"], []).append(r["value"])
    finally:
        counts.unpersist()
    schema = T.StructType.fromDDL(PROFILE_SCHEMA)
    kept = schema.names[: schema.names.index("stats")]
    rows = [
        (*(f[name] for name in kept), stats.get(f["ordinal"]), tops.get(f["ordinal"]), samples.get(f["ordinal"], []))
        for f in sorted(facts, key=lambda f: f["ordinal"])
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def _is_key() -> Column:
    key = F.col("column_key")
    unique = (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("total_count")) & (F.col("total_count") > 0)
    named = (key == "id") | key.endswith("_id") | key.endswith("_code") | key.endswith("_sku")
    return unique & (named | (F.col("semantic_role") == "identifier") | (F.col("inferred_type") == "id"))


def recommendations(facts: DataFrame) -> DataFrame:
    """One row: key candidate, the first time column, all measures and all dimensions in column order.

    The key candidate is the first column that is unique, filled and of an identifier kind, role or name.
    """
    def first(test: Column) -> Column:
        return F.min_by("column_key", F.when(test, F.col("ordinal")))

    def keys(role: str) -> Column:
        hits = F.array_sort(F.collect_list(F.when(F.col("semantic_role") == role, F.struct("ordinal", "column_key"))))
        return F.transform(hits, lambda r: r["column_key"])

    return facts.agg(
        first(_is_key()).alias("primary_key_candidate"),
        first(F.col("semantic_role") == "time").alias("recommended_time_column"),
        keys("measure").alias("recommended_measures"),
        keys("dimension").alias("recommended_dimensions"),
    )


def shareable(profile: DataFrame) -> DataFrame:
    """A profile without its frequency lists."""
    return profile.drop("top_values")


def subset(profile: DataFrame, keys: Iterable[str]) -> DataFrame:
    """A profile of selected columns; key and time recommendations follow from what is left."""
    return profile.where(F.col("column_key").isin(list(keys)))


def profile_tables(tables: dict[str, DataFrame], orders: dict[str, Column] | None = None, kinds_by_look: bool = False) -> DataFrame:
    """Profiles of several tables under one ``table_name``."""
    out = None
    for name, df in tables.items():
        one = profile_table(df, (orders or {}).get(name), kinds_by_look=kinds_by_look).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out
