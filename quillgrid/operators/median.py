"""Exact medians of many columns without gathering a column in one task.

``percentile`` keeps a map of all distinct values of a group in one buffer. Here the middle rank is found by narrowing:
a histogram over order-preserving buckets names the bucket that holds the rank, and the next histogram splits that
bucket, until few distinct values are left. Buckets per column are bounded, and only one row per column comes back to
the driver each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# 32 steps per factor e over the range of a double: at most some 45,000 buckets a column, each about 3 % wide.
_LOG_STEPS = 32
# Splitting such a bucket twice leaves at most some 2^16 distinct doubles, so the loop below ends.
_SPLIT = 65_536


def by_ordinal(values: dict[int, float], kind: str = "double") -> Column:
    """A constant per column ordinal, in place of a join with one row per column; null for columns left out."""
    listed = [F.lit(values.get(i)).cast(kind) for i in range(max(values) + 1)]
    return F.get(F.array(*listed), F.col("ordinal"))


def _holding_rank(histogram: DataFrame) -> list[Row]:
    """Per column the bucket that holds the rank: what lies before it, its value range and its distinct values."""
    running = Window.partitionBy("ordinal").orderBy("bucket")
    before = F.col("upto") - F.col("n")
    rank = F.floor((F.col("total") - 1) / 2) - F.col("seen")
    return (
        histogram.withColumn("upto", F.sum("n").over(running))
        .where((before <= rank) & (rank < F.col("upto")))
        .select("ordinal", "total", (F.col("seen") + before).alias("seen"), "low", "high", "distinct")
        .collect()
    )


def _histogram(values: DataFrame, bucket: Column) -> DataFrame:
    return values.groupBy("ordinal", bucket.alias("bucket")).agg(
        F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("distinct")
    )


def lower_medians(values: DataFrame) -> dict[int, tuple[float, int]]:
    """The lower middle value of each column and its number of values, from ``(ordinal, v double, n)``."""
    v = F.col("v")
    # Any never-decreasing map of the value keeps ranks right; the logarithm is one.
    coarse = _histogram(values, F.floor(F.signum(v) * F.log1p(F.abs(v)) * _LOG_STEPS))
    coarse = coarse.withColumn("total", F.sum("n").over(Window.partitionBy("ordinal"))).withColumn("seen", F.lit(0))
    found: dict[int, tuple[float, int]] = {}
    state = {r["ordinal"]: r for r in _holding_rank(coarse)}
    while state:
        found.update({o: (r["low"], r["total"]) for o, r in state.items() if r["low"] == r["high"]})
        state = {o: r for o, r in state.items() if r["low"] < r["high"]}
        if not state:
            break
        low, high = (by_ordinal({o: r[c] for o, r in state.items()}) for c in ("low", "high"))
        inside = values.where(F.col("ordinal").isin(list(state)) & v.between(low, high))
        # Few values left: every value is its own bucket. Otherwise the range is cut evenly.
        few = F.coalesce(by_ordinal({o: r["distinct"] for o, r in state.items()}, "bigint") <= _SPLIT, F.lit(False))
        bucket = F.when(few, v).otherwise(F.floor((v - low) / ((high - low) / _SPLIT)).cast("double"))
        split = _histogram(inside, bucket)
        for name in ("total", "seen"):
            split = split.withColumn(name, by_ordinal({o: r[name] for o, r in state.items()}, "bigint"))
        state = {r["ordinal"]: r for r in _holding_rank(split)}
    return found
