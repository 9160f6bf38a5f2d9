import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quillgrid.streaming.quota import _InTimeOrder, admit_events, admit_stream, minute_counts, minute_quota
from quillgrid.streaming.windows import _Ledger, event_windows, joint_quota


def plain_loop(rows, limit, window):
    """Every event of a key in time order against the admitted times still in the window."""
    out, logs = {}, {}
    for i, key, ms in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = logs[key] = [t for t in logs.get(key, []) if ms - t < window]
        if len(log) >= limit:
            out[i] = (False, 0, max(1, -(-(window - (ms - log[0])) // 1000)))
        else:
            log.append(ms)
            out[i] = (True, limit - len(log), 0)
    return out


def events(spark, rows):
    pdf = pd.DataFrame([(i, k, pd.Timestamp(ms, unit="ms")) for i, k, ms in rows], columns=["id", "key", "ts"])
    return spark.createDataFrame(pdf)


def decisions(df):
    return {r["id"]: (r["admitted"], r["remaining"], r["retry_after_seconds"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "limit"), [(0, 1), (1, 5), (2, 30)])
def test_admission_against_a_loop(spark, seed, limit):
    rng = random.Random(seed)
    spans = {"busy": 30_000, "steady": 600_000, "sparse": 40_000_000}
    rows = []
    for i in range(3000):
        key = rng.choice(["busy", "busy", "steady", "sparse"])
        ms = rng.randint(0, spans[key])
        rows.append((i, key, ms // 1000 * 1000 if rng.random() < 0.5 else ms))
    got = decisions(admit_events(events(spark, rows).repartition(6), ["key"], "ts", limit, 60_000, "id"))
    assert got == plain_loop(rows, limit, 60_000)


def test_refusals_leave_no_trace(spark):
    rows = [(0, "a", 0), (1, "a", 30_000), (2, "a", 59_999), (3, "a", 60_000), (4, "a", 60_001)]
    got = decisions(admit_events(events(spark, rows), ["key"], "ts", 1, 60_000, "id"))
    assert got == {0: (True, 0, 0), 1: (False, 0, 30), 2: (False, 0, 1), 3: (True, 0, 0), 4: (False, 0, 60)}


def run_stream(spark, make, source, tmp_path):
    stream = make(spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source))
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_stream_decides_in_time_order(spark, tmp_path):
    """Events come in any order within the lateness, over many micro-batches; those that come later are marked."""
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), rng.randint(1, 400_000)) for i in range(400)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randint(0, 50_000))
    source = str(tmp_path / "in")
    for part in range(6):
        events(spark, arrival[part * 67 : (part + 1) * 67]).coalesce(1).write.mode("append").parquet(source)
    late = [(1000, "a", 5), (1001, "c", 10)]
    events(spark, late).coalesce(1).write.mode("append").parquet(source)
    out = run_stream(spark, lambda s: admit_stream(s, ["key"], "ts", 3, 60_000, "60 seconds", tie="id"), source, tmp_path)
    assert {r["id"] for r in out.where("late").collect()} == {1000, 1001} and out.where("late and admitted is null").count() == 2
    passed = max(r[2] for r in rows) - 60_000
    want = {i: d for i, d in plain_loop(rows, 3, 60_000).items() if dict((r[0], r[2]) for r in rows)[i] < passed}
    assert decisions(out.where("not late")) == want and len(want) > 300
    # What waits is decided when the stream goes on.
    events(spark, [(2000, "z", 10_000_000)]).coalesce(1).write.mode("append").parquet(source)
    more = run_stream(spark, lambda s: admit_stream(s, ["key"], "ts", 3, 60_000, "60 seconds", tie="id"), source, tmp_path)
    assert decisions(more.where("not late")) == plain_loop(rows, 3, 60_000)


class Store:
    """State variables of one key in memory, and how often they were called."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, *_):
        entries = {}

        class Map:
            def updateValue(_, k, v):
                self.calls += 1
                entries[k] = v

            def getValue(_, k):
                self.calls += 1
                return entries.get(k)

            def removeKey(_, k):
                self.calls += 1
                del entries[k]

        return Map()

    def getValueState(self, *_):
        held = []

        class Value:
            def exists(_):
                self.calls += 1
                return bool(held)

            def get(_):
                return held[0]

            def update(_, v):
                self.calls += 1
                held[:] = [v]

            def clear(_):
                held.clear()

        return Value()

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_stream_holds_events_in_chunks(spark):
    """The store is called for chunks of events, not for each; chunks that overlap in time and ties are decided as in one pass."""
    rng = random.Random(3)
    rows = [(i, "a", rng.randint(0, 90_000) // 50 * 50) for i in range(6000)]
    rng.shuffle(rows)
    store, step = Store(), _InTimeOrder(["c0"], 7, 10_000)
    step.init(store)
    batches = [pd.DataFrame([(i, ms, i if i % 2 else float(i)) for i, _, ms in rows[at : at + 2000]], columns=["c0", "ms", "tie"]) for at in range(0, 6000, 2000)]
    assert not list(step.handleInputRows(("a",), iter(batches), Mark(0)))
    out = list(step.handleExpiredTimer(("a",), Mark(40_000), None)) + list(step.handleExpiredTimer(("a",), Mark(80_000), None))
    found = {r.c0: (r.admitted, r.remaining, r.retry_after_seconds) for pdf in out for r in pdf.itertuples()}
    assert found == {i: d for i, d in plain_loop(rows, 7, 10_000).items() if dict((r[0], r[2]) for r in rows)[i] < 80_000}
    assert store.calls < 100 and store.timers[-1] == 80_001


def test_stream_keeps_columns_and_a_limit_of_none_admitted(spark, tmp_path):
    source = str(tmp_path / "in")
    df = events(spark, [(i, None if i == 1 else "a", 1000 + i * 1000) for i in range(3)] + [(9, "a", 900_000)])
    df = df.selectExpr("*", "id * 2 as _other", "cast(id as decimal(10,2)) as ms", "array(id, null) as tie", "if(id = 2, null, ts) as at").drop("ts")
    df.coalesce(1).write.parquet(source)
    out = run_stream(spark, lambda s: admit_stream(s, ["key"], "at", 0, 60_000), source, tmp_path)
    found = {r["id"]: (r["key"], r["_other"], r["ms"], r["tie"], r["admitted"], r["retry_after_seconds"], r["late"]) for r in out.collect()}
    assert found == {0: ("a", 0, 0, [0, None], False, 60, False), 1: (None, 2, 1, [1, None], False, 60, False), 2: ("a", 4, 2, [2, None], None, None, True)}


def plain_windows(rows, window):
    counts, start = {}, {}
    for _, key, ms in sorted(rows, key=lambda r: r[2]):
        if key not in start or ms - start[key] >= window:
            start[key] = ms
        counts[key, start[key]] = counts.get((key, start[key]), 0) + 1
    return counts


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_from_first_events(spark, seed):
    """Dense and sparse keys, several events a moment, gaps of many windows."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), int(rng.choice([1e6, 3e6, 2e7]) * rng.random()) // rng.choice([1, 7000]) * 7) for i in range(1200)]
    found = event_windows(events(spark, rows).repartition(3), ["key"], "ts", 60_000).collect()
    assert {(r["key"], r["window_start"]): r["n"] for r in found} == plain_windows(rows, 60_000) and len(found) > 50
    whole = event_windows(events(spark, rows), [], "ts", 60_000).collect()
    assert {(None, r["window_start"]): r["n"] for r in whole} == plain_windows([(i, None, ms) for i, _, ms in rows], 60_000)
    assert event_windows(events(spark, rows).where("1 = 0"), ["key"], "ts").collect() == []


def plain_joint(rows, window, all_limit, actor_limit, actions):
    """One pass over all events; a refused event is charged to nothing."""
    held, out = {}, {}
    for ms, i, actor, action in sorted((ms, i, actor, action) for i, actor, action, ms in rows):
        if action not in actions:
            out[i] = (False, "invalid", None)
            continue
        held = {k: w for k, w in held.items() if w[0] > ms - window}
        keys = [("global", (), all_limit), ("actor", (actor,), actor_limit), ("actor_action", (actor, action), actions[action])]
        full = next(((scope, key) for scope, key, limit in keys if key in held and held[key][1] >= limit), None)
        if full:
            out[i] = (False, full[0], max(1, math.ceil((held[full[1]][0] + window - ms) / 1000)))
            continue
        for _, key, _ in keys:
            held.setdefault(key, [ms, 0])[1] += 1
        out[i] = (True, None, 0)
    return out


@pytest.mark.parametrize(("seed", "span", "slabs"), [(1, 400_000, 1), (2, 3_000_000, 3), (3, 20_000_000, 60)])
def test_joint_quota(spark, seed, span, slabs):
    """Busy and quiet times; short slabs depend on each other, so they are decided over several rounds."""
    rng = random.Random(seed)
    rows = [(i, rng.choice("uvwx"), rng.choice(["ask", "ask", "test", "other"]), int(span * rng.random() ** 2)) for i in range(900)]
    actions = {"ask": 4, "test": 2}
    df = spark.createDataFrame(pd.DataFrame([(i, a, b, pd.Timestamp(ms, unit="ms"), 0.5) for i, a, b, ms in rows], columns=["id", "who", "what", "ts", "state"]))
    found = joint_quota(df.repartition(4), "who", "what", "ts", "id", 60_000, 8, 5, actions, slabs).collect()
    assert {r["id"]: (r["allowed"], r["scope"], r["retry_after_seconds"]) for r in found} == plain_joint(rows, 60_000, 8, 5, actions)
    assert len(found) == len(rows) and found[0]["state"] == 0.5
    assert {r["scope"] for r in found} >= {"global", "invalid", None}


def test_full_windows_are_jumped_over():
    """A dense slab costs as many decisions as its windows admit or refuse on their own, not one an event."""

    class Counted(_Ledger):
        asked = 0

        def decide(self, *event):
            Counted.asked += 1
            return super().decide(*event)

    ms = np.arange(0, 1_000_000, 5)
    actors, actions = pa.array([f"u{i % 50}" for i in range(len(ms))]), pa.array(["x"] * len(ms))
    quick, slow = Counted(None, 60_000, (8, 2, {"x": 1})), _Ledger(None, 60_000, (8, 2, {"x": 1}))
    quick.pass_over(ms, actors, actions)
    for event in zip(ms.tolist(), actors.to_pylist(), actions.to_pylist()):
        slow.decide(*event)
    alive = lambda ledger: [w for w in ledger.state() if 1_000_000 - w["start"] < 60_000]
    assert alive(quick) == alive(slow) != [] and Counted.asked < 1000


def test_joint_quota_of_odd_events(spark):
    rows = [(1, None, "query-ask", None), (2, "a", None, None), (3, "a", "query-ask", None)]
    found = joint_quota(spark.createDataFrame(rows, "id int, actor string, action string, ts timestamp"), "actor", "action", "ts").collect()
    assert {(r["allowed"], r["scope"]) for r in found} == {(False, "invalid")} and len(found) == 3
    assert joint_quota(spark.createDataFrame([], "id int, actor string, action string, ts timestamp"), "actor", "action", "ts").collect() == []


def test_minute_quota(spark, tmp_path):
    rows = [(i, "u1", i * 1000) for i in range(40)] + [(100 + i, "u2", 70_000 + i) for i in range(5)]
    df = events(spark, rows).selectExpr("key as actor", "'query-ask' as action", "ts")
    found = {(r["scope"], str(r["minute"])[14:16], r["actor"]): (r["n"], r["limit"], r["over_limit"]) for r in minute_quota(df, "actor", "action", "ts").collect()}
    assert found["global", "00", None] == (40, 120, False) and found["actor", "00", "u1"] == (40, 30, True)
    assert found["actor_action", "01", "u2"] == (5, 30, False) and len(found) == 6
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    closed = run_stream(spark, lambda s: minute_counts(s, "actor", "action", "ts", "5 seconds"), source, tmp_path).collect()
    # The second minute is still open when the stream ends.
    assert [(r["actor"], r["n"]) for r in closed] == [("u1", 40)]
