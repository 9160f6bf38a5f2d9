"""Best-fit packing of token ids into sequences of bounded length, in bulk-synchronous supersteps.

``encode`` turns texts into pieces: the ids of a document with its end id, cut only where they exceed the capacity.
``place`` finds a sequence and an offset for every piece. A piece as long as a sequence is one. The others, and the
gaps of opened sequences, go through supersteps until none is left:

1. *Open.* As many new sequences as sequential best fit would open for these sizes, by their counts alone.
2. *Range sort.* Unplaced pieces and gaps are dealt to tasks by size, largest first, and sorted there. Ties are broken by a
   hash, so a size that most rows share is spread over tasks.
3. *Successor sweep.* Each task passes once over its range. A piece takes the smallest gap that holds it; the gap shrinks and
   serves again. A gap is wanted by pieces of its own size first, and they stand next to it.
4. *Conflicts by rank.* Pieces without a gap in their range and the gaps left are ranked, largest first, over all ranges. Rank
   modulo the number of tasks says which task decides: each gets its share of all sizes on both sides, no gap stands in two, and
   a second sweep places what fits, larger pieces first.
5. *Update.* Gaps go on as they are then; pieces that found none wait for the next superstep.

Sizes are whole numbers up to the capacity, so what a superstep tells the driver is at most a count for every size and
one row a task. Every sweep writes its results to the shared folder; a lost executor costs one sweep.

Null texts count as empty: a piece of the end id alone. Rows with the same or no key are separate documents. An empty table
gives no pieces. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.encoding import WordEncoder
from quillgrid.llm.textbatch import slices
from quillgrid.session import stored

CAPACITY = 2048
#: Rows that a task of a superstep sorts, where there are more tasks than the session's shuffle partitions.
TASK_ROWS = 1 << 18
#: Rows below which a further task is not worth its start.
_LEAST_ROWS = 1 << 14


def encode(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", encoder=WordEncoder) -> DataFrame:
    """Pieces of all documents: ``piece_id`` (any distinct numbers), the key, ``piece`` (from 0), ``start`` (the document's
    ids before it), ``length`` and ``ids`` (little-endian unsigned 32-bit).

    Numbers of pieces depend on how the rows lie in partitions: store the frame before it is read twice.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    long = T.LongType()
    kinds = {"piece_id": long, "key": rows.schema["key"].dataType, "piece": T.IntegerType(), "start": long, "length": long, "ids": T.BinaryType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])

    def run(batches):
        ids_of, number = encoder.kept(vocabulary_path, shared), TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            row, cut, pieces = [], [], []
            for i, t in enumerate(texts):
                ids = ids_of(t) + end
                for at in range(0, len(ids), width):
                    row.append(i)
                    cut.append(at // width)
                    pieces.append(ids[at : at + width])
            piece = np.array(cut, np.int64)
            columns = [
                pa.array(number + np.arange(len(row))), part.column("key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(piece * capacity), pa.array([len(p) // 4 for p in pieces], pa.int64()), pa.array(pieces, pa.binary()),
            ]
            number += len(row)
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


#: Rows of a sweep. ``kind`` is placed (a piece in a sequence), gap (as it is now), waiting (a piece that found no gap) or
#: count (one a task: waiting pieces in ``at``, gaps in ``size``). ``at`` numbers a task's waiting pieces, and its gaps.
_STEP = "part int, kind string, piece_id bigint, sequence_id bigint, size bigint, offset bigint, at bigint"
_NAMES = [c.split()[0] for c in _STEP.split(", ")]
_TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _STEP.split(", ")]
_ROWS = 1 << 14


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _TYPES)], _NAMES)


def _in_batches(rows):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield _batch(held)
            held = []
    yield _batch(held)


def _values(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _swept(rows, part: int, capacity: int):
    """One task's successor sweep over (size, piece_id, sequence_id) in descending order of size, gaps before pieces."""
    # Gaps by room, and a bit for every room that has one: the successor is the lowest bit from a size on.
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    has, waiting = 0, 0
    for size, piece, sequence in rows:
        if piece is None:
            rooms[size].append(sequence)
            has |= 1 << size
            continue
        above = has >> size
        if not above:
            yield part, "waiting", piece, None, size, None, waiting
            waiting += 1
            continue
        room = size + (above & -above).bit_length() - 1
        sequence = rooms[room].pop()
        if not rooms[room]:
            has ^= 1 << room
        yield part, "placed", piece, sequence, size, capacity - room, None
        rooms[room - size].append(sequence)
        has |= 1 << room - size
    gaps = 0
    for room in range(capacity, 0, -1):
        for sequence in rooms[room]:
            yield part, "gap", None, sequence, room, None, gaps
            gaps += 1
    yield part, "count", None, None, gaps, None, waiting


def _tasks(rows: int, spark) -> int:
    return max(rows // TASK_ROWS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // _LEAST_ROWS)) + 1


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``piece_id``, ``sequence_id`` and ``offset`` of every piece; a sequence's pieces lie side by side from 0 on.

    ``pieces`` has distinct numbers ``piece_id`` from 0 on and ``length`` from 1 to the capacity, and reads the same each time.
    """
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") == capacity).select("piece_id", (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting = pieces.where(F.col("length") < capacity).select("piece_id", F.col("length").alias("size"))
    gaps = spark.createDataFrame([], "sequence_id bigint, size bigint")
    placed, opened, before = [whole], 0, None
    order = [F.col("size").desc(), F.col("piece_id").isNotNull(), F.xxhash64("piece_id", "sequence_id")]

    def sweep(batches):
        return _in_batches(_swept(_values(batches, "size", "piece_id", "sequence_id"), TaskContext.get().partitionId(), capacity))

    while True:
        sizes = waiting.select("size", F.lit(True).alias("piece")).unionByName(gaps.select("size", F.lit(False).alias("piece")))
        counts = sizes.groupBy("piece", "size").count().collect()
        long = {r["size"]: r["count"] for r in counts if r["piece"]}
        room = {r["size"]: r["count"] for r in counts if not r["piece"]}
        if not long:
            return reduce(DataFrame.unionByName, placed)
        # Where a superstep placed nothing, gaps that would do stood in other tasks: pieces get new ones.
        new, before = _lacking(long, {} if long == before else room, capacity), long
        # Gaps smaller than every piece are full for good.
        gaps = gaps.where(F.col("size") >= min(long))
        gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("size")))
        opened += new

        nothing = F.lit(None).cast("long")
        pool = waiting.select("size", "piece_id", nothing.alias("sequence_id")).unionByName(gaps.select("size", nothing.alias("piece_id"), "sequence_id"))
        tasks = _tasks(sum(long.values()) + sum(n for size, n in room.items() if size >= min(long)) + new, spark)
        dealt = pool.repartitionByRange(tasks, *order) if tasks > 1 else pool.repartition(1)
        near = stored(dealt.sortWithinPartitions(*order).mapInArrow(sweep, _STEP))
        placed.append(near.where("kind = 'placed'").select("piece_id", "sequence_id", "offset"))
        found = near.where("kind = 'count'").select("part", "at", "size").collect()
        rest = sum(r["at"] for r in found)
        if not rest:
            return reduce(DataFrame.unionByName, placed)

        ranked = near.where("kind in ('waiting', 'gap')").join(spark.createDataFrame(_starts(found), "part int, pieces bigint, gaps bigint"), "part")
        rank = F.col("at") + F.when(F.col("kind") == "gap", F.col("gaps")).otherwise(F.col("pieces"))
        tasks = _tasks(rest, spark)
        dealt = ranked.repartition(tasks, F.pmod(rank, F.lit(tasks))) if tasks > 1 else ranked.repartition(1)
        far = stored(dealt.sortWithinPartitions(*order).mapInArrow(sweep, _STEP))
        placed.append(far.where("kind = 'placed'").select("piece_id", "sequence_id", "offset"))
        waiting = far.where("kind = 'waiting'").select("piece_id", "size")
        gaps = far.where("kind = 'gap'").select("sequence_id", "size")


def _lacking(pieces: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many sequences sequential best fit would open; pieces and gaps are counts by size."""
    rooms, opened = [0] * (capacity + 1), 0
    for room, n in gaps.items():
        rooms[room] += n
    for size, n in sorted(pieces.items(), reverse=True):
        room = size
        while n:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                rooms[capacity] = more = -(-n // (capacity // size))
                opened, room = opened + more, capacity
            fit = min(n, rooms[room])
            rooms[room] -= fit
            rooms[room - size] += fit
            n, room = n - fit, size if room >= 2 * size else room
    return opened


def _starts(counts: list) -> list[tuple[int, int, int]]:
    """The rank of each task's first waiting piece and first gap; ``counts`` has (part, waiting pieces, gaps) of each."""
    out, pieces, gaps = [], 0, 0
    for part, waiting, free in sorted(counts):
        out.append((part, pieces, gaps))
        pieces, gaps = pieces + waiting, gaps + free
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with their ``sequence_id`` and ``offset``."""
    return pieces.join(place(pieces.select("piece_id", "length"), capacity), "piece_id")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, and the offsets at which its pieces begin; a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    found = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return found.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("parts.offset").alias("starts"))
