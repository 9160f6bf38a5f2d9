"""Request quotas over event time.

Sliding log: per key, an event is admitted while fewer than N admitted events are younger than the window; refused
events leave no trace. Minute quota: events per minute for all, per actor, and per actor and action, with limits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Window of the sliding log and limits of the minute quota.
WINDOW_MS = 60_000
GLOBAL_LIMIT, ACTOR_LIMIT = 120, 30
ACTION_LIMITS = {"llm-test": 5, "query-ask": 30, "spec-refine": 20}

_DECISION = "admitted boolean, remaining int, retry_after_seconds int"


def _quiet_runs(moments: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Moments ``(keys, _ms, _n)`` with the number of their run: a run ends where a key is silent for a whole window.

    No admitted event outlives such a silence, so runs are decided independently. They are found from one row per key
    and window-long slot.
    """
    slotted = moments.withColumn("_slot", F.floor(F.col("_ms") / window))
    slots = slotted.groupBy(*keys, "_slot").agg(F.min("_ms").alias("first_ms"), F.max("_ms").alias("last_ms"))
    by_time = Window.partitionBy(*keys).orderBy("_slot")
    silent = F.col("first_ms") - F.lag("last_ms").over(by_time) >= window
    runs = slots.withColumn("_starts", F.when(silent, 1).otherwise(0)).withColumn("_run", F.sum("_starts").over(by_time))
    return slotted.join(runs.select(*keys, "_slot", "_run"), [*keys, "_slot"]).drop("_slot")


def _decide_moments(ms: np.ndarray, n: np.ndarray, log: list[int], limit: int, window: int) -> tuple[np.ndarray, ...]:
    """Per moment of one run: room before it, and the wait of what is refused at it. ``log`` carries over.

    While the log is full nothing is admitted until its oldest entry leaves, so those moments are passed in one step.
    """
    room, wait, i = np.zeros(len(ms), dtype="int64"), np.zeros(len(ms), dtype="int64"), 0
    if limit < 1:
        return room, wait + window
    while i < len(ms):
        now = int(ms[i])
        while log and now - log[0] >= window:
            log.pop(0)
        free = limit - len(log)
        if free > 0:
            room[i] = free
            log.extend([now] * min(int(n[i]), free))
            wait[i] = window - (now - log[0])
            i += 1
        else:
            until = i + int(np.searchsorted(ms[i:], log[0] + window))
            wait[i:until] = window - (ms[i:until] - log[0])
            i = until
    return room, wait


def admit_events(
    events: DataFrame, keys: list[str], time: str, limit: int, window_ms: int = WINDOW_MS, tie: str | None = None
) -> DataFrame:
    """Every event with ``admitted``, ``remaining`` and ``retry_after_seconds``; ``tie`` orders events of one moment.

    What is decided in sequence is one row per key and millisecond with its number of events, so a key with a third of
    all events costs no more than the time it spans; a silence of a whole window lets its parts run side by side. The
    sequence streams through a sorted partition and holds at most ``limit`` times. Events then take their moment's
    decision by their place within it.
    """
    columns = events.columns
    timed = events.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp")))
    moments = timed.groupBy(*keys, "_ms").agg(F.count(F.lit(1)).alias("_n"))
    laid_out = _quiet_runs(moments, keys, window_ms).repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_ms")
    run_key = [*keys, "_run"]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, []
        for batch in batches:
            starts = (batch[run_key] != batch[run_key].shift()).any(axis=1).to_numpy().nonzero()[0]
            ms, n = batch["_ms"].to_numpy(), batch["_n"].to_numpy()
            parts = []
            runs = zip(*(batch[k].to_numpy()[starts] for k in run_key))
            for run, at, end in zip(runs, starts, [*starts[1:], len(batch)]):
                if run != current:
                    current, log = run, []
                parts.append(_decide_moments(ms[at:end], n[at:end], log, limit, window_ms))
            if parts:
                room, wait = (np.concatenate(p) for p in zip(*parts))
                yield batch[[*keys, "_ms"]].assign(_room=room, _wait=wait)

    key_fields = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    decided = laid_out.select(*run_key, "_ms", "_n").mapInPandas(decide, f"{key_fields}, _ms bigint, _room bigint, _wait bigint")
    in_moment = Window.partitionBy(*keys, "_ms").orderBy(*([tie] if tie else [F.lit(0)]))
    placed = timed.withColumn("_place", F.row_number().over(in_moment)).join(decided, [*keys, "_ms"])
    admitted = F.col("_place") <= F.col("_room")
    return placed.select(
        *columns,
        admitted.alias("admitted"),
        F.when(admitted, F.col("_room") - F.col("_place")).otherwise(0).cast("int").alias("remaining"),
        F.when(admitted, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_wait") / 1000))).cast("int").alias("retry_after_seconds"),
    )


#: The state store that event buffers need: on disk, with one column family for each kind of state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InTimeOrder(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then decides them in time order.

    State per key: the waiting events in chunks as they came, an index of the chunks by time, the admitted times still in the
    window, and when the key is due next. Chunks that are due are read twice, one at a time: first only their times are kept,
    which decide all, then each comes out with its decisions.
    """

    def __init__(self, columns: list[str], limit: int, window: int):
        self.columns, self.limit, self.window = columns, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "number bigint", "events binary")
        self.index = handle.getValueState("index", "numbers array<bigint>, firsts array<bigint>")
        self.log = handle.getValueState("log", "times array<bigint>")
        self.due = handle.getValueState("due", "ms bigint")

    def _chunks(self) -> dict[int, int]:
        """The earliest time of every waiting chunk by its number."""
        return {int(n): int(ms) for n, ms in zip(*self.index.get())} if self.index.exists() else {}

    def _hold(self, chunks: dict[int, int], number: int, events: pd.DataFrame) -> None:
        chunks[number] = int(events["ms"].min())
        self.waiting.updateValue((number,), (pickle.dumps(events),))

    def _chunk(self, number: int) -> pd.DataFrame:
        return pickle.loads(self.waiting.getValue((number,))[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, chunks, added = timerValues.getCurrentWatermarkInMs(), None, []
        for pdf in rows:
            ms = pdf["ms"]
            # Before the first batch is through there is no watermark yet.
            late = ms.isna() | ((ms < passed) & (passed > 0))
            if not late.all():
                chunks = self._chunks() if chunks is None else chunks
                added.append(max(chunks, default=-1) + 1)
                self._hold(chunks, added[-1], pdf.loc[~late, [*self.columns, "ms", "tie"]].astype({"ms": "int64"}))
            if late.any():
                yield self._out(pdf.loc[late, self.columns], None, None, None, True)
        if added:
            self.index.update(([*chunks], [*chunks.values()]))
            self._wake(min(chunks[n] for n in added) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        chunks = self._chunks()
        log = [int(t) for t in self.log.get()[0]] if self.log.exists() else []
        due = [n for n, first in chunks.items() if first < passed]
        if due:
            times = [e.loc[e["ms"] < passed, ["ms", "tie"]] for e in map(self._chunk, due)]
            decided = iter(np.split(self._decided(times, log), np.cumsum([len(t) for t in times])[:-1], axis=1))
            del times
            for n, (admitted, remaining, retry) in zip(due, decided):
                events = self._chunk(n)
                ready = events["ms"] < passed
                yield self._out(events.loc[ready, self.columns], admitted.astype(bool), remaining, retry, False)
                if ready.all():
                    self.waiting.removeKey((n,))
                    del chunks[n]
                else:
                    self._hold(chunks, n, events[~ready])
            self.index.update(([*chunks], [*chunks.values()]))
        if chunks:
            self._wake(min(chunks.values()) + 1)
        elif log and log[-1] + self.window >= passed:
            self._wake(log[-1] + self.window + 1)
        else:
            # The key is silent and remembers nothing.
            self.log.clear()
            self.index.clear()
            return
        self.log.update((log,))

    def _decided(self, times: list[pd.DataFrame], log: list[int]) -> np.ndarray:
        """Three rows, for all events in the order of ``times``: admitted, remaining and seconds to wait; ``log`` carries over."""
        ms, tie = np.concatenate([t["ms"].to_numpy() for t in times]), pd.concat([t["tie"] for t in times], ignore_index=True)
        unknown = tie.isna().to_numpy()
        if tie.dtype == object and not unknown.all():
            keys = tie.to_list()
            order = np.array(sorted(range(len(ms)), key=lambda i: (ms[i], unknown[i], 0 if unknown[i] else keys[i])))
        else:
            order = np.lexsort((ms,) if unknown.all() else (tie.to_numpy(), unknown, ms))
        moments, first, n = np.unique(ms[order], return_index=True, return_counts=True)
        room, wait = _decide_moments(moments, n, log, self.limit, self.window)
        left = np.repeat(room, n) - (np.arange(len(ms)) - np.repeat(first, n) + 1)
        out = np.empty((3, len(ms)), "int64")
        out[:, order] = left >= 0, np.maximum(left, 0), np.where(left >= 0, 0, np.maximum(1, -(-np.repeat(wait, n) // 1000)))
        return out

    def _wake(self, ms: int) -> None:
        """One timer a key, at the earliest time asked for."""
        if self.due.exists():
            (before,) = self.due.get()
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def _out(self, events: pd.DataFrame, admitted, remaining, retry, late: bool) -> pd.DataFrame:
        out = events.assign(admitted=admitted, remaining=remaining, retry_after_seconds=retry, late=late)
        return out.astype({"admitted": "object", "remaining": "Int32", "retry_after_seconds": "Int32"})

    def close(self) -> None:
        pass


def admit_stream(
    events: DataFrame, keys: list[str], time: str, limit: int, window_ms: int = WINDOW_MS, lateness: str = "1 minute", tie: str | None = None
) -> DataFrame:
    """The sliding log on a stream: every event with its decision as ``admit_events`` gives it, and ``late``.

    An event waits in the state store until the watermark has passed it; then all that wait are decided in time order, in whatever
    order and micro-batches they came. An event that is older than the watermark when it comes, or has no time, comes out
    at once with ``late`` and no decision. Events newer than the watermark wait when a stream ends, and are
    decided when it goes on. A key holds the events of one lateness and the log of one window, in RocksDB on disk, a
    chunk of events an entry; this function selects that store for the session. A key that is silent for a window is forgotten.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields = [*events.schema.fields]
    # Rows travel as named tuples, which know no names with a leading underscore and none twice.
    inside = [f"c{n}" for n in range(len(fields))]
    times = events.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", lateness)
    given = times.select(
        *[F.col(f"`{f.name}`").alias(c) for f, c in zip(fields, inside)],
        F.unix_millis("__time").alias("ms"),
        (F.col(f"`{tie}`") if tie else F.lit(None).cast("int")).alias("tie"),
        *[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)],
    )
    out = T.StructType([T.StructField(c, f.dataType) for f, c in zip(fields, inside)])
    for name, kind in (("admitted", T.BooleanType()), ("remaining", T.IntegerType()), ("retry_after_seconds", T.IntegerType()), ("late", T.BooleanType())):
        out = out.add(name, kind)
    decided = given.groupBy(*[f"k{n}" for n in range(len(keys))]).transformWithStateInPandas(_InTimeOrder(inside, limit, window_ms), out, "append", "eventtime")
    return decided.toDF(*[f.name for f in fields], "admitted", "remaining", "retry_after_seconds", "late")


def _limit_of(actions: dict[str, int]) -> Column:
    limit = F.lit(None).cast("int")
    for action, n in actions.items():
        limit = F.when(F.col("action") == action, n).otherwise(limit)
    return limit


def minute_quota(events: DataFrame, actor: str, action: str, time: str, action_limits: dict[str, int] | None = None) -> DataFrame:
    """Events per minute and scope (global, actor, actor and action) with their limit and whether it is exceeded.

    Minutes are clock minutes, an approximation of windows that start at a key's first event. The finest counts are
    made first, combined where the events are read; the wider scopes add them up, so the global scope moves few rows.
    Works on a batch; for a stream see ``minute_counts``.
    """
    fine = minute_counts(events, actor, action, time)
    limits = ACTION_LIMITS if action_limits is None else action_limits
    none = F.lit(None).cast("string")
    scopes = [
        fine.groupBy("minute").agg(F.sum("n").alias("n")).select("minute", F.lit("global").alias("scope"), none.alias("actor"), none.alias("action"), "n"),
        fine.groupBy("minute", "actor").agg(F.sum("n").alias("n")).select("minute", F.lit("actor").alias("scope"), "actor", none.alias("action"), "n"),
        fine.select("minute", F.lit("actor_action").alias("scope"), "actor", "action", "n"),
    ]
    limit = F.when(F.col("scope") == "global", GLOBAL_LIMIT).when(F.col("scope") == "actor", ACTOR_LIMIT).otherwise(_limit_of(limits))
    union = scopes[0].unionByName(scopes[1]).unionByName(scopes[2])
    return union.withColumn("limit", limit.cast("int")).withColumn("over_limit", F.coalesce(F.col("n") > F.col("limit"), F.lit(False)))


def minute_counts(events: DataFrame, actor: str, action: str, time: str, lateness: str | None = None) -> DataFrame:
    """Events per minute, actor and action; with ``lateness`` on a stream, minutes close once the watermark passes."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    if lateness is not None:
        events = events.withWatermark(time, lateness)
    minute = F.window(F.col(time), "1 minute")
    counted = events.groupBy(minute.alias("w"), F.col(actor).cast("string").alias("actor"), F.col(action).cast("string").alias("action"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "actor", "action", "n")
