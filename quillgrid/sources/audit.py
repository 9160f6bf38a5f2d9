"""Checks of incoming files and grids, reported as columns instead of errors."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .lines import CHUNK_BYTES, file_system

# Limits of a single upload.
MAX_BYTES, MAX_ROWS, MAX_COLUMNS, MAX_SHEETS = 10 * 1024 * 1024, 200_000, 200, 20
PROBE_BYTES = 4096
# First bytes of zip (two kinds), legacy office, and known binary files; byte-order marks; macro types.
ZIP_STARTS = ["504B0304", "504B0506"]
OLE_START = "D0CF11E0A1B11AE1"
BINARY_STARTS = ["7F454C46", "25504446", "4D5A", "89504E47", "47494638"]
UTF8_MARK, UTF16_MARKS = "EFBBBF", ["FFFE", "FEFF"]
MACRO_EXTENSIONS = ["xlsm", "xlsb", "xltm", "xlam", "xlm", "xla"]


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``length`` of all files below the paths, empty ones too; names that begin with a dot or underscore are hidden.

    Folders are listed in tasks, one level after the other, so the driver never holds a listing. The last part of a path
    may have wildcards.
    """
    asked = [paths] if isinstance(paths, str) else list(paths)
    folders, found = spark.createDataFrame([(p, True) for p in asked], "path string, given boolean"), []
    while True:
        level = stored(folders.repartition("path").mapInArrow(_list, "path string, length bigint, folder boolean"))
        found.append(level.where("not folder").select("path", "length"))
        folders = level.where("folder").select("path", F.lit(False).alias("given"))
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for asked, given in zip(batch.column("path").to_pylist(), batch.column("given").to_pylist()):
            system, path = file_system(asked)
            scheme = asked[: asked.index(":")] if "://" in asked or asked.startswith("file:") else "file"
            base, _, pattern = path.rstrip("/").rpartition("/")
            if given and re.search(r"[*?\[]", pattern):
                infos = [i for i in system.get_file_info(fs.FileSelector(base)) if fnmatch.fnmatchcase(i.base_name, pattern)]
            else:
                own = system.get_file_info(path)
                if own.type == fs.FileType.NotFound:
                    raise FileNotFoundError(asked)
                infos = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
            shown = [i for i in infos if not i.base_name.startswith((".", "_"))]
            start = "file:" if scheme == "file" else f"{scheme}://"
            yield pa.RecordBatch.from_arrays(
                [pa.array([start + i.path for i in shown], pa.string()), pa.array([i.size or 0 for i in shown], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in shown], pa.bool_())],
                ["path", "length", "folder"],
            )


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with their size, first bytes and digest: ``path, length, head, sha256``.

    A file of any size streams through one task in chunks; no row holds more than its first ``PROBE_BYTES`` and a mark.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sums = [], []
            for path in batch.column("path").to_pylist():
                system, at = file_system(path)
                head, total = b"", hashlib.sha256()
                with system.open_input_file(at) as file:
                    while chunk := file.read(CHUNK_BYTES):
                        total.update(chunk)
                        head = head or chunk[: PROBE_BYTES + 3]
                heads.append(head)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(sums, pa.string())], ["path", "length", "head", "sha256"])

    # Files of one folder were listed by one task.
    return list_files(spark, paths).repartition("path").mapInArrow(digest, "path string, length bigint, head binary, sha256 string")


def _starts(head: Column, *marks: str) -> Column:
    test = F.lit(False)
    for m in marks:
        test = test | head.startswith(m)
    return test


def _looks_binary(content: Column, head: Column) -> Column:
    """Known binary starts, a zero byte, or more than a tenth control characters at the start; UTF-16 text passes."""
    # Latin-1 maps every byte to one character, so byte counts are character counts.
    probe = F.decode(F.substring(content, 1, PROBE_BYTES), "ISO-8859-1")
    probe = F.when(head.startswith(UTF8_MARK), F.substring(probe, 4, PROBE_BYTES)).otherwise(probe)
    control = F.regexp_count(probe, F.lit("[\\x01-\\x08\\x0e-\\x1f]"))
    text = ~F.contains(probe, F.lit("\x00")) & (control <= F.length(probe) * 0.1)
    known = F.when(F.length(content) >= 4, _starts(head, *BINARY_STARTS)).otherwise(F.lit(False))
    return known | (~_starts(head, *UTF16_MARKS) & ~text)


def content_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of files as ``read_files`` gives them, or of a column ``content``."""
    return files.select("path", "sha256" if "sha256" in files.columns else F.sha2("content", 256).alias("sha256"))


def audit_files(files: DataFrame) -> DataFrame:
    """One row per file ``(path, length, head)`` or ``(path, content)``: size, extension, type by content, delimiter kind and a status."""
    size = F.col("length") if "length" in files.columns else F.length("content")
    files = files.withColumn("content", F.col("head")) if "head" in files.columns else files
    head = F.hex(F.substring("content", 1, 8))
    last = F.element_at(F.split("path", r"\."), -1)
    staged = files.select("path", "content", size.alias("n_bytes"), F.lower(F.trim(last)).alias("extension"), head.alias("head"))
    ext, head = F.col("extension"), F.col("head")
    zipped, ole = _starts(head, *ZIP_STARTS), _starts(head, OLE_START)
    probe = F.decode(F.substring("content", 1, PROBE_BYTES), "ISO-8859-1")
    tabs, commas = F.regexp_count(probe, F.lit("\t")), F.regexp_count(probe, F.lit(","))
    delimited = F.when(ext.isin("tsv", "csv"), ext).when(tabs > commas, "tsv").otherwise("csv")
    binary = _looks_binary(F.col("content"), head)
    status = (
        F.when(F.col("n_bytes") == 0, "empty")
        .when(F.col("n_bytes") > MAX_BYTES, "too_large")
        .when(ext.isin(MACRO_EXTENSIONS), "macro")
        .when((zipped | ole) & ext.isin("csv", "tsv"), "mismatch")
        .when(zipped | ole, "ok")
        .when(binary, "binary")
        .otherwise("ok")
    )
    kind = F.when(zipped, "xlsx").when(ole, "xls").when(~binary, delimited)
    return staged.select("path", "n_bytes", "extension", F.when(status == "ok", kind).alias("file_type"), status.alias("status"))


def audit_bounds(grid: DataFrame) -> DataFrame:
    """One row per sheet with its size and whether it exceeds the limits of a single upload."""
    sheets = grid.groupBy("file_id", "sheet").agg(
        (F.max("row_idx") + 1).alias("n_rows"), F.max(F.size("cells")).cast("bigint").alias("n_columns")
    )
    per_file = sheets.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_sheets"))
    return sheets.join(per_file, "file_id").select(
        "*",
        (F.col("n_rows") > MAX_ROWS).alias("too_many_rows"),
        (F.col("n_columns") > MAX_COLUMNS).alias("too_many_columns"),
        (F.col("n_sheets") > MAX_SHEETS).alias("too_many_sheets"),
    )


def within_bounds(grid: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """A grid cut to the limits, for callers that want truncation instead of a flag."""
    return grid.where(F.col("row_idx") < max_rows).withColumn("cells", F.slice("cells", 1, max_columns))
