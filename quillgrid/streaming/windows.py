"""Quota windows that start at a key's first event, exact and without one task per key.

A window opens at the first event of a key that no earlier window covers and lasts a fixed time; ``event_windows`` counts them.
``joint_quota`` charges every event to several keys at once (all, its actor, its actor and action): it is refused if any of
their windows is full, and a refused event is charged to none of them, nor opens a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.session import stored
from quillgrid.streaming.quota import ACTION_LIMITS, ACTOR_LIMIT, GLOBAL_LIMIT, WINDOW_MS

#: Windows that a slab of ``joint_quota`` is long.
SLAB_WINDOWS = 60


def event_windows(events: DataFrame, keys: list[str], time: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """One row per window: the keys, ``window_start`` (milliseconds since 1970) and ``n``, the events in it.

    Whether a moment opens a window depends on the window before it, so the openings of a key form a chain: each leads to the first
    moment at least a window later. Chains are followed by pointer doubling: round k knows the 2**k-th opening after
    any moment, so rounds grow with the logarithm of a chain. A window is as long as a slot of time, so successors
    and members are found inside (key, slot) groups; only one row per key and slot is ever ordered by key. Events without a time do not count; a null
    key is a key.
    """
    moments = events.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp"))).where("_ms is not null").groupBy(*keys, "_ms").agg(F.count(F.lit(1)).alias("_n"))
    moments = stored(moments.select(*[F.col(f"`{k}`") for k in keys], "_ms", "_n", F.floor(F.col("_ms") / window_ms).alias("_slot")))
    key = [F.col(f"`{k}`") for k in keys]

    # The successor lies in the next slot, at or after the same place in it, or it is the first moment of a later slot.
    slots = moments.groupBy(*keys, "_slot").agg(F.min("_ms").alias("_first"))
    asked = moments.select(*key, (F.col("_ms") + window_ms).alias("_at"), F.col("_ms").alias("_from"), (F.col("_slot") + 1).alias("_slot"))
    met = moments.select(*key, F.col("_ms").alias("_at"), F.lit(None).cast("long").alias("_from"), "_slot").unionByName(asked)
    onward = Window.partitionBy(*keys, "_slot").orderBy("_at", F.col("_from").isNull()).rowsBetween(0, Window.unboundedFollowing)
    found = met.withColumn("_next", F.first(F.when(F.col("_from").isNull(), F.col("_at")), ignorenulls=True).over(onward)).where("_from is not null")
    # Where a slot has no such moment, it is the first one of the slots after it.
    missing = found.where("_next is null").select(*key, "_slot").distinct().withColumn("_first", F.lit(None).cast("long"))
    spaces = slots.select(*key, "_slot", "_first").unionByName(missing)
    later = Window.partitionBy(*keys).orderBy("_slot", F.col("_first").isNull()).rowsBetween(1, Window.unboundedFollowing)
    after = spaces.withColumn("_late", F.first("_first", ignorenulls=True).over(later)).where("_first is null").select(*key, "_slot", "_late")
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    full = found.where("_next is not null").select(*key, F.col("_from").alias("_ms"), "_next")
    open_ = found.where("_next is null").alias("a").join(after.alias("b"), [*same, F.col("a._slot") == F.col("b._slot")], "left")
    jump = stored(full.unionByName(open_.select(*[F.col(f"a.`{k}`") for k in keys], F.col("a._from").alias("_ms"), F.col("b._late").alias("_next"))).where("_next is not null"))

    starts = stored(moments.groupBy(*keys).agg(F.min("_ms").alias("_ms")))
    while not jump.isEmpty():
        moved = starts.alias("a").join(jump.alias("b"), [*same, F.col("a._ms") == F.col("b._ms")]).select(*[F.col(f"a.`{k}`") for k in keys], F.col("b._next").alias("_ms"))
        starts = stored(starts.unionByName(moved))
        twice = jump.alias("a").join(jump.alias("b"), [*same, F.col("a._next") == F.col("b._ms")])
        jump = stored(twice.select(*[F.col(f"a.`{k}`") for k in keys], F.col("a._ms"), F.col("b._next")))

    # A moment belongs to the latest opening before it, which lies in its slot or in the one before.
    reach = starts.select(*key, F.col("_ms").alias("_start"), F.explode(F.array(F.floor(F.col("_ms") / window_ms), F.floor(F.col("_ms") / window_ms) + 1)).alias("_slot"))
    inside = [*same, F.col("a._slot") == F.col("b._slot"), F.col("a._ms") >= F.col("b._start"), F.col("a._ms") < F.col("b._start") + window_ms]
    members = moments.alias("a").join(reach.alias("b"), inside).select(*[F.col(f"a.`{k}`") for k in keys], F.col("_start").alias("window_start"), "_n")
    return members.groupBy(*keys, "window_start").agg(F.sum("_n").alias("n"))


_STATE = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())]))
_ARROW_STATE = pa.list_(pa.struct([("key", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))


class _Ledger:
    """Windows by key: their start and what was charged to them."""

    def __init__(self, state: list[dict] | None, window: int, limits: tuple[int, int, dict[str, int]]):
        self.windows = {w["key"]: [w["start"], w["n"]] for w in state or []}
        self.window, (self.all, self.actor, self.actions) = window, limits
        self.seen = 0

    def decide(self, now: int | None, actor: str | None, action: str | None) -> tuple[bool, str | None, int | None]:
        cap = self.actions.get(action) if actor is not None and now is not None else None
        if cap is None:
            return False, "invalid", None
        self.seen += 1
        if self.seen % 4096 == 0:
            self.windows = {k: w for k, w in self.windows.items() if now - w[0] < self.window}
        keys = (("global", "*", self.all), ("actor", f"a{actor}", self.actor), ("actor_action", f"b{len(actor)}:{actor}{action}", cap))
        for scope, key, limit in keys:
            start, n = self.windows.get(key) or (now, 0)
            if now - start < self.window and n >= limit:
                return False, scope, max(1, -(-(start + self.window - now) // 1000))
        for _, key, _ in keys:
            held = self.windows.get(key)
            if held is None or now - held[0] >= self.window:
                self.windows[key] = [now, 1]
            else:
                held[1] += 1
        return True, None, 0

    def pass_over(self, ms: np.ndarray, actors: pa.Array, actions: pa.Array) -> None:
        """Charge valid events in order. While all is full nothing else is asked of an event, so these are left out in one step."""
        i = 0
        while i < len(ms):
            start, n = self.windows.get("*") or (None, 0)
            if n >= self.all and start is not None and ms[i] - start < self.window:
                i += int(np.searchsorted(ms[i:], start + self.window))
                continue
            some = slice(i, i + 256)
            for now, actor, action in zip(ms[some].tolist(), actors[some].to_pylist(), actions[some].to_pylist()):
                allowed, scope, _ = self.decide(now, actor, action)
                if scope == "global" and self.all > 0:
                    break
                i += 1

    def state(self) -> list[dict]:
        return [{"key": k, "start": s, "n": n} for k, (s, n) in sorted(self.windows.items())]


def joint_quota(
    events: DataFrame, actor: str, action: str, time: str, tie: str | None = None, window_ms: int = WINDOW_MS, global_limit: int = GLOBAL_LIMIT,
    actor_limit: int = ACTOR_LIMIT, action_limits: dict[str, int] | None = None, slab_windows: int = SLAB_WINDOWS,
) -> DataFrame:
    """Every event with ``allowed``, ``scope`` (what refused it) and ``retry_after_seconds``; ``tie`` orders events of one moment.

    Time is cut into slabs that are passed over side by side, from the windows that are open when they begin. Those are taken
    to be none at first; then what one slab leaves open is handed to the next, and only slabs that began with something else
    are passed over again, until no slab did. The first wrong slab is right after each round, so the result is that of one
    pass over all events; after a quiet window, slabs do not depend on each other at all. Rounds read times and names only and
    jump over events while all is full; when all slabs begin right, every event is decided, once. Windows open at a time are bounded by the global limit. One row a slab is ordered as a whole.

    Events without an actor, a time or a limit for their action are refused as ``invalid`` and charged to nothing.
    """
    spark = events.sparkSession
    limits = (global_limit, actor_limit, dict(ACTION_LIMITS if action_limits is None else action_limits))
    length = window_ms * slab_windows
    ms = F.unix_millis(F.col(f"`{time}`").cast("timestamp"))
    own = T.StructType(events.schema.fields)
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns]) if events.columns else F.struct(F.lit(0))
    base = events.select(
        row.alias("row"), ms.alias("ms"), F.col(f"`{actor}`").cast("string").alias("actor"), F.col(f"`{action}`").cast("string").alias("action"),
        (F.col(f"`{tie}`") if tie else F.lit(0)).alias("tie"), F.coalesce(F.floor(ms / length), F.lit(-(2**62))).alias("slab"), F.lit(1).alias("kind"), F.lit(None).cast(_STATE).alias("state"),
    )
    base = stored(base)
    slabs = stored(base.groupBy("slab").agg(F.min("ms").alias("first_ms")))
    nothing = F.array().cast(_STATE)
    todo = used = stored(slabs.select("slab", nothing.alias("state")))
    schema = T.StructType([*base.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("scope", T.StringType()), T.StructField("retry_after_seconds", T.LongType())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, slab = None, None

        def left(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([w for _, w in found], _ARROW_STATE)], ["slab", "state"])

        for batch in batches:
            found, begun = [], np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            for at, end in zip([-1, *begun], [*begun, batch.num_rows]):
                if at >= 0:
                    if ledger is not None:
                        found.append((slab, ledger.state()))
                    slab, ledger = batch.column("slab")[at].as_py(), _Ledger(batch.column("state")[at].as_py(), window_ms, limits)
                if end > at + 1:
                    events = batch.slice(at + 1, end - at - 1)
                    ledger.pass_over(events.column("ms").to_numpy(), events.column("actor"), events.column("action"))
            if found:
                yield left(found)
        if ledger is not None:
            yield left([(slab, ledger.state())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger = None
        for batch in batches:
            found, states = [], batch.column("state")
            for i, (kind, now, who, what) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "ms", "actor", "action")))):
                if kind == 0:
                    ledger = _Ledger(states[i].as_py(), window_ms, limits)
                    found.append((None, None, None))
                else:
                    found.append(ledger.decide(now, who, what))
            allowed, scope, retry = zip(*found) if found else ((), (), ())
            more = [pa.array(allowed, pa.bool_()), pa.array(scope, pa.string()), pa.array(retry, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "allowed", "scope", "retry_after_seconds"])

    def fed(rows: DataFrame, begins: DataFrame) -> DataFrame:
        """Every slab's events in order, behind a row with what is open when it begins."""
        given = {"slab": F.col("slab"), "kind": F.lit(0), "state": F.col("state")}
        begin = begins.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields])
        return rows.unionByName(begin).repartition("slab").sortWithinPartitions("slab", "kind", "ms", "tie")

    # Only valid events are charged, and only their times and names tell what a slab leaves open.
    charged = base.where(F.col("ms").isNotNull() & F.col("actor").isNotNull() & F.col("action").isin([a for a, n in limits[2].items() if n is not None])).drop("row")
    last = None
    while True:
        ended = stored(fed(charged.join(todo.select("slab"), "slab", "left_semi").select(*charged.columns), todo).mapInArrow(ends, T.StructType([base.schema["slab"], T.StructField("state", _STATE)])))
        last = ended if last is None else stored(last.join(ended, "slab", "left_anti").unionByName(ended))
        # One row a slab.
        before = slabs.join(last, "slab").withColumn("open", F.lag("state").over(Window.orderBy("slab")))
        alive = F.filter("open", lambda w: F.col("first_ms") - w["start"] < window_ms)
        begins = stored(before.select("slab", F.coalesce(alive, nothing).alias("state")))
        changed = begins.alias("a").join(used.alias("b"), "slab").where(~F.col("a.state").eqNullSafe(F.col("b.state"))).select("slab", "a.state")
        todo, used = stored(changed), begins
        if todo.isEmpty():
            break
    decided = fed(base, used).mapInArrow(decide, schema).where("kind = 1")
    return decided.select("row.*", "allowed", "scope", "retry_after_seconds")
