"""Lines of text files in any of the usual encodings and line ends, read in byte ranges.

``probe`` looks at the first bytes of every file: byte-order mark, counts of delimiters, and whether a carriage return stands
without a line feed. ``read_lines`` then cuts files into ranges of bytes. A range owns the lines that begin in it: it skips
to the first one, looking back one code unit (two bytes in UTF-16) to see whether one begins right there, and
reads on past its end until its last line is complete. So files are cut anywhere, and a task holds one chunk and one line.

Spark lists the files; tasks open them through pyarrow's file systems (local and mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: bytes looked at to tell encoding, line ends and delimiter.
HEAD_BYTES = 4096
RANGE_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
#: Ranges beyond this number share tasks.
MOST_TASKS = 1 << 14
_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
#: Names of compressed files, which are read as one stream.
_PACKED = re.compile(r"\.(gz|bz2|zst|lz4)$", re.IGNORECASE)

_FILES = "file_id string, length bigint"
_PROBED = f"{_FILES}, encoding string, skip int, lone_cr boolean, commas bigint, tabs bigint, semicolons bigint"
LINES = "file_id string, block_start bigint, line_no bigint, value string, line_end string"


def file_system(uri: str, escaped: bool = False):
    """The pyarrow file system of a path or URI, and the path in it; Spark's metadata column has escaped URIs."""
    from pyarrow import fs

    plain = unquote(uri) if escaped else uri
    scheme, _, rest = plain.partition(":") if _SCHEME.match(plain) else ("file", "", plain)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return fs.FileSystem.from_uri(plain)


def _chunks(file_id: str, start: int) -> Iterator[bytes]:
    """The bytes of a file from a place on; compressed files are unpacked."""
    system, path = file_system(file_id, escaped=True)
    if _PACKED.search(path):
        with system.open_input_stream(path, compression="detect") as stream:
            while chunk := stream.read(CHUNK_BYTES):
                yield chunk
        return
    with system.open_input_file(path) as file:
        file.seek(start)
        while chunk := file.read(CHUNK_BYTES):
            yield chunk


def _head(file_id: str) -> tuple[str, int, bool, int, int, int]:
    whole = b""
    for chunk in _chunks(file_id, 0):
        whole += chunk[:HEAD_BYTES]
        if len(whole) >= HEAD_BYTES:
            break
    head = whole[:HEAD_BYTES]
    mark, encoding = next(((m, e) for m, e in _MARKS if head.startswith(m)), (b"", "utf-8"))
    text = head[len(mark) :].decode(encoding, errors="ignore")
    # A carriage return at the very end may have its line feed behind it.
    lone = bool(re.search(r"\r(?!\n|\Z)", text)) or (text.endswith("\r") and len(whole) < HEAD_BYTES and "\n" not in text)
    return encoding, len(mark), lone, text.count(","), text.count("\t"), text.count(";")


def probe(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file: ``file_id``, ``length``, ``encoding``, ``skip`` (bytes of its mark), ``lone_cr`` (lines end at carriage returns too) and
    how often the delimiters occur in its first bytes. Only those bytes are read."""
    # Spark lists the files; their content is not asked for.
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file_id"), "length")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(_head(f) for f in batch.column("file_id").to_pylist()))) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(found, kinds)]], [c.split()[0] for c in _PROBED.split(", ")])

    return files.mapInArrow(look, _PROBED)


def _line_ends(data: bytes, encoding: str, lone_cr: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where lines end (the byte behind) and how many bytes each end takes; the last byte of a carriage return may be undecided."""
    kind = {"utf-8": "u1", "utf-16-le": "<u2", "utf-16-be": ">u2"}[encoding]
    unit = np.dtype(kind).itemsize
    units = np.frombuffer(data, kind, len(data) // unit)
    feeds = units == 10
    if not lone_cr:
        at = np.flatnonzero(feeds)
        return (at + 1) * unit, np.full(len(at), unit)
    returns = units == 13
    returns[:-1] &= ~feeds[1:]
    at = np.flatnonzero(feeds | returns)
    return (at + 1) * unit, np.full(len(at), unit)


def range_lines(file_id: str, length: int, encoding: str, skip: int, lone_cr: bool, start: int, end: int) -> Iterator[tuple[str, str]]:
    """The lines that begin in a range of bytes, each with what ends it ("" at the end of the file)."""
    unit = 2 if encoding.startswith("utf-16") else 1
    begin = max(start, skip)
    feed, cr = ("\n".encode(encoding), "\r".encode(encoding))
    # From one unit before the range: whether a line begins right at its start.
    from_ = begin - unit if begin > skip else begin
    held, at, waiting = b"", from_, begin > skip
    for chunk in _chunks(file_id, from_):
        held += chunk
        ends, sizes = _line_ends(held, encoding, lone_cr)
        # A carriage return at the end of what is read may be half of a line end; a feed that comes first is another half.
        if lone_cr and len(ends) and ends[-1] == len(held) - len(held) % unit and held[ends[-1] - unit : ends[-1]] == cr and at + ends[-1] < length:
            ends, sizes = ends[:-1], sizes[:-1]
        done = 0
        for stop, size in zip(ends.tolist(), sizes.tolist()):
            if waiting:
                # Up to here the line belongs to an earlier range.
                waiting, done = False, stop
                continue
            if at + done >= end:
                return
            yield held[done : stop - size].decode(encoding, errors="replace"), "\n" if held[stop - size : stop] == feed else "\r"
            done = stop
        held, at = held[done:], at + done
        if not waiting and at >= end:
            return
    if held and not waiting and at < end:
        yield held.decode(encoding, errors="replace"), ""


def read_lines(probed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of probed files as ``LINES``: without their end, numbered inside their range (``block_start``)."""
    step = max(2, range_bytes - range_bytes % 2)
    packed = F.col("file_id").rlike(f"(?i){_PACKED.pattern}")
    last = F.when(packed, 0).otherwise(F.greatest(F.col("length") - 1, F.lit(0)))
    ranges = probed.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))))
    ranges = ranges.withColumn("stop", F.when(packed, F.lit(2**62)).otherwise(F.col("start") + step)).withColumn("length", F.when(packed, F.lit(2**62)).otherwise(F.col("length")))
    # A range is a task's worth of work, whatever the listing's partitions were; without a number of its own the shuffle would bring these
    # few short rows together in one task.
    (number,) = ranges.agg(F.count(F.lit(1))).first()
    ranges = ranges.repartition(min(max(number, 1), MOST_TASKS), F.xxhash64("file_id", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINES.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                out, number = [], 0
                for value, ended in range_lines(r["file_id"], r["length"], r["encoding"], r["skip"], r["lone_cr"], r["start"], r["stop"]):
                    out.append((r["file_id"], r["start"], number, value, ended))
                    number += 1
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return ranges.select("file_id", "length", "encoding", "skip", "lone_cr", "start", "stop").mapInArrow(read, LINES)
