"""Token ids in Re-Pair compressed shards.

Documents are sorted by key over range partitions; a partition's ids are cut into shards of about ``SHARD`` ids at
document ends. Re-Pair then replaces frequent pairs of neighbouring symbols by nonterminals: every round counts all
pairs of the shard, takes those at or above the round's share of the shard, lets the more frequent of two overlapping
occurrences win, and names each pair once as a rule; rounds end when no pair occurs ``MIN_COUNT`` times. Rules never cross a document's end, so a document is a slice of
the compressed sequence and can be decoded alone.

A shard is one row of a Parquet table, written by Spark's committer: ``part`` and ``shard`` (their order is the
order of keys), ``start`` (ids of the partition before it), ``n_ids``, and little-endian arrays: ``keys`` (int64), ``key_null``
(bytes), ``lengths`` (uint32, ids per document, end id included), ``at`` (uint32, first symbol of each document),
``symbols`` (uint32), ``left`` and ``right`` (uint32, rule parts), ``expanded`` (uint32, expansion lengths by rule).
Symbols below ``terminals`` are ids, the others number the rules in order; rules refer to earlier rules only.

Null texts count as empty: only the end id. Null keys come first; repeated keys stand next to each other, ordered by
text. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.encoding import ByteLevelEncoder
from quillgrid.llm.textbatch import slices

SHARD = 1 << 19
MIN_COUNT = 12
#: The first rounds take only pairs that make up at least this share of the symbols; then all of MIN_COUNT occurrences, until none is left.
ROUNDS = (2**-9, 2**-11, 2**-13, 2**-15, 2**-17)
#: Slots of the pair counter; its tables fit a core's cache.
_COUNTER_BITS = 17

SHARD_SCHEMA = (
    "part int, shard int, start bigint, n_ids bigint, terminals bigint, keys binary, key_null binary, lengths binary, at binary, symbols binary, left binary, right binary, expanded binary"
)


def _keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pairs at some places as single numbers."""
    return s[at].astype(np.uint64) << np.uint64(32) | s[at + 1]


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, first symbol of each document, rule parts and expansion lengths.

    ``ends`` are the positions of each document's last id; every document holds at least one.
    """
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[ends] = True
    lefts, rights, size = [], [], np.ones(terminals, np.uint32)
    shares = [0.0, *ROUNDS[::-1]]
    while shares and len(s) > 1:
        share = shares[-1]
        # Pairs are counted by a hash of 32-bit arithmetic; a slot of its own takes what crosses a document's end.
        slot = (s[:-1] * np.uint32(0x9E3779B1) + s[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - _COUNTER_BITS)
        slot[last[:-1]] = 1 << _COUNTER_BITS
        counts = np.bincount(slot, minlength=(1 << _COUNTER_BITS) + 1).astype(np.int32)
        counts[-1] = 0
        counts[counts < max(MIN_COUNT, int(len(s) * share))] = 0
        count = counts[slot]
        if not share:
            # Pairs that shared a slot are told apart before rounds may end.
            often = np.flatnonzero(count)
            _, which, times = np.unique(_keys(s, often), return_inverse=True, return_counts=True)
            count[often] = np.where(times >= MIN_COUNT, times, 0)[which]
        # Of two overlapping occurrences the more frequent pair wins, of equal ones the one at the odd place.
        rank = 2 * count
        rank[1::2] += 1
        rises = rank[1:] > rank[:-1]
        take = count > 0
        take[1:] &= rises
        take[:-1] &= ~rises
        where = np.flatnonzero(take)
        if share:
            shares.pop()
        elif not len(where):
            break
        pairs, rule, uses = np.unique(_keys(s, where), return_inverse=True, return_counts=True)
        worth = uses > 2
        if not worth.any():
            continue
        where, rule = where[worth[rule]], (np.cumsum(worth) - 1)[rule[worth[rule]]]
        pairs = pairs[worth]
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        s[where] = len(size) + rule
        last[where] = last[where + 1]
        keep = np.ones(len(s), bool)
        keep[where + 1] = False
        s, last = s[keep], last[keep]
        lefts.append(left)
        rights.append(right)
        size = np.concatenate([size, size[left] + size[right]])
    at = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(ends) else np.zeros(0)
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return s, at.astype(np.uint32), joined(lefts), joined(rights), size[terminals:]


def expansions(left: np.ndarray, right: np.ndarray, expanded: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all symbols in one array, with each symbol's place and length there."""
    size = np.concatenate([np.ones(terminals, np.int64), expanded.astype(np.int64)])
    place = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:terminals] = np.arange(terminals)
    done = terminals
    while done < len(size):
        # All rules that refer to finished symbols only.
        waiting = np.flatnonzero(np.maximum(left[done - terminals :], right[done - terminals :]) >= done)
        upto = done + int(waiting[0]) if len(waiting) else len(size)
        l, r = left[done - terminals : upto - terminals], right[done - terminals : upto - terminals]
        both = np.stack([l, r], 1).ravel().astype(np.int64)
        flat[place[done] : place[upto - 1] + size[upto - 1]] = _gather(flat, place[both], size[both])
        done = upto
    return flat, place, size


def _gather(flat: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return flat[np.repeat(place - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, expanded: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    flat, place, size = expansions(left, right, expanded, terminals)
    return _gather(flat, place[symbols], size[symbols])


def write_shards(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD, plain: bool = False) -> None:
    """Encode every text, append the end id, and write the shards in ascending order of the key below a shared folder.

    Strings of added tokens inside texts become their ids, as in the library; ``plain`` reads them as ordinary text.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        coder, part = ByteLevelEncoder.kept(vocabulary_path, shared, plain), TaskContext.get().partitionId()
        waiting, held, shard, start, end = [], 0, 0, 0, np.array([end_id], "<u4").tobytes()
        terminals = max(coder.size, end_id + 1)

        def row():
            ids = np.concatenate([x for x, _, _ in waiting])
            lengths = np.concatenate([x for _, x, _ in waiting])
            keys = [k for _, _, found in waiting for k in found]
            s, at, left, right, expanded = compress(ids, np.cumsum(lengths) - 1, terminals)
            arrays = [
                np.array([k or 0 for k in keys], "<i8"), np.array([k is None for k in keys], np.uint8), lengths.astype("<u4"),
                at.astype("<u4"), s.astype("<u4"), left.astype("<u4"), right.astype("<u4"), expanded.astype("<u4"),
            ]
            numbers = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([terminals], pa.int64())]
            return pa.RecordBatch.from_arrays([*numbers, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], [f.split()[0] for f in SHARD_SCHEMA.split(", ")])

        for slice_ in slices(batches, "text"):
            found = [coder(t) + end for t in slice_.column("text").to_pylist()]
            whole = np.frombuffer(b"".join(found), "<u4")
            waiting.append((whole, np.array([len(x) // 4 for x in found], np.int64), slice_.column("key").to_pylist()))
            held += len(whole)
            if held >= shard_ids:
                yield row()
                waiting, shard, start, held = [], shard + 1, start + held, 0
        if waiting:
            yield row()

    rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of written shards: key, start (ids of all documents before it), n_tokens and ids."""
    return _documents(spark, folder, "ids binary", lambda ids: pa.array([x.tobytes() for x in ids], pa.binary()))


def digest_shards(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read_shards``, with the crc32 of the ids in place of the ids."""
    return _documents(spark, folder, "ids_crc32 bigint", lambda ids: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()))


def _documents(spark: SparkSession, folder: str, field: str, derive) -> DataFrame:
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                u4 = {c: np.frombuffer(r[c], "<u4") for c in ("lengths", "at", "symbols", "left", "right", "expanded")}
                ids = expand(u4["symbols"], u4["left"], u4["right"], u4["expanded"], r["terminals"]).astype("<u4")
                size = u4["lengths"].astype(np.int64)
                end = np.cumsum(size)
                nulls = np.frombuffer(r["key_null"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["keys"], "<i8"), pa.int64(), mask=nulls),
                        pa.array(np.full(len(size), r["part"]), pa.int32()),
                        pa.array(r["start"] + end - size),
                        pa.array(size),
                        derive(np.split(ids, end[:-1])),
                    ],
                    ["key", "part", "within", "n_tokens", field.split()[0]],
                )

    # One row per partition of the sort: their number is that of its tasks, not of documents.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = shards.mapInArrow(run, f"key bigint, part int, within bigint, n_tokens bigint, {field}")
    return found.join(before, "part").select("key", (F.col("before") + F.col("within")).alias("start"), "n_tokens", field.split()[0])


def access(shard: dict, number: int) -> np.ndarray:
    """The ids of one document of a shard row, expanding only the rules it uses."""
    u4 = {c: np.frombuffer(shard[c], "<u4") for c in ("at", "symbols", "left", "right")}
    stop = int(u4["at"][number + 1]) if number + 1 < len(u4["at"]) else len(u4["symbols"])
    out, stack = [], u4["symbols"][int(u4["at"][number]) : stop][::-1].tolist()
    while stack:
        x = stack.pop() - shard["terminals"]
        if x < 0:
            out.append(x + shard["terminals"])
        else:
            stack += [int(u4["right"][x]), int(u4["left"][x])]
    return np.array(out, "<u4")

