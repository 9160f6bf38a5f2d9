"""Delimited text files as grid rows, whatever their size.

A grid has one row per record of a file: ``(file_id, sheet, row_idx, cells)`` with ``cells`` an array of
``(raw, kind)``. No header is assumed; blank and ragged rows stay, and quoted fields may hold line breaks.

Files are read in splits. Whether a split begins inside a quoted field is known only from what precedes it, so a first
pass works out, per split, where it would end from either start; chaining these short summaries gives every split its
true start and its first row number. The second pass then cuts records independently. Only records that cross a split
are brought together, one group per record.

Files are probed first, a few bytes each. If all are UTF-8 whose lines end in line feeds, Spark's own text reader reads
them; else the ranges of ``lines`` do, which know UTF-16 with a mark and lone carriage returns.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import NUMBER_TEXT
from ..session import shared_folder, stored
from .lines import probe, read_lines

DELIMITERS = [",", "\t", ";"]
# Fixed value: the name of a text file's only sheet.
SHEET = "Sheet1"

# A private-use character that takes the place of carriage returns while a record is cut.
_SHIELD = "\ue000"

_SUMMARY = "file_id string, block_start bigint, delimiter string, end_out boolean, rows_out bigint, end_in boolean, rows_in bigint"
_PIECES = "file_id string, row_idx bigint, block_start bigint, delimiter string, record string, fields array<string>"


def ends_quoted(line: str, quoted: bool, delimiter: str) -> bool:
    """Whether a quoted field is open after the line. Quotes open a field only at its very beginning."""
    at = 0
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            quoted, at = False, at + 1
        elif at < len(line) and line[at] == '"':
            quoted, at = True, at + 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1
        if at < len(line) and line[at] == '"':
            quoted, at = True, at + 1


def split_fields(record: str, delimiter: str) -> list[str | None]:
    """The fields of one record, empty ones as None."""
    # A carriage return inside a field is data here, but the csv module would end the record at it.
    shielded = record.removesuffix("\r").replace("\r", _SHIELD)
    for fields in csv.reader([shielded], delimiter=delimiter):
        return [f.replace(_SHIELD, "\r") or None for f in fields]
    return []


def _split_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Consecutive lines of one split, batch by batch."""
    for batch in batches:
        change = (batch["file_id"] != batch["file_id"].shift()) | (batch["block_start"] != batch["block_start"].shift())
        for _, run in batch.groupby(change.cumsum(), sort=False):
            yield (run["file_id"].iat[0], int(run["block_start"].iat[0])), run


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state = None, {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame(
            [(*current, d, state[d, False][0], state[d, False][1], state[d, True][0], state[d, True][1]) for d in DELIMITERS],
            columns=["file_id", "block_start", "delimiter", "end_out", "rows_out", "end_in", "rows_in"],
        )

    for split, run in _split_runs(batches):
        if split != current:
            if current is not None:
                yield rows()
            # Open quote and records begun, for each delimiter and each possible start.
            current = split
            state = {(d, start): (start, 0) for d in DELIMITERS for start in (False, True)}
        lines = run["value"]
        quoted_at = lines.str.contains('"', regex=False).to_numpy().nonzero()[0]
        for key, (quoted, begun) in state.items():
            done = 0
            for at in quoted_at:
                # Lines without a quote change nothing: each begins a record, or none does.
                begun += 0 if quoted else int(at) - done + 1
                quoted, done = ends_quoted(lines.iat[at], quoted, key[0]), int(at) + 1
            begun += 0 if quoted else len(lines) - done
            state[key] = (quoted, begun)
    if current is not None:
        yield rows()


def _lines(spark: SparkSession, paths: str | list[str], probed: DataFrame) -> DataFrame:
    if not probed.where("lone_cr or encoding <> 'utf-8'").isEmpty():
        return read_lines(probed)
    text = spark.read.option("lineSep", "\n").text(paths)
    first = F.col("block_start") == 0
    return text.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
        F.lit("\n").alias("line_end"),
    ).withColumn("value", F.when(first, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))


def _chosen_delimiter() -> Column:
    name = F.lower(F.col("file_id"))
    comma_or_semicolon = F.when(F.col("semicolons") > F.col("commas"), ";").otherwise(",")
    return F.when(name.endswith(".tsv"), "\t").when(name.endswith(".csv"), comma_or_semicolon).when(F.col("tabs") > F.col("commas"), "\t").otherwise(comma_or_semicolon)


def detect_delimiter(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file_id, delimiter)``: the extension decides, else the commoner of tab and comma at the start of the file.

    Semicolons replace commas when they are the commoner of the two.
    """
    return probe(spark, paths).where("length > 0").select("file_id", _chosen_delimiter().alias("delimiter"))


def _placed_splits(summary: DataFrame, heads: DataFrame) -> DataFrame:
    """Per split: the file's delimiter, whether it begins quoted, and the number of records begun before it.

    A split maps its start to its end, so the state after several is the composition of their maps. Two starts lead to
    one end as soon as a split ends alike from both; a running count of flips since the last such split does the rest.
    """
    own = summary.join(heads.select("file_id", _chosen_delimiter().alias("delimiter")), ["file_id", "delimiter"])
    earlier = Window.partitionBy("file_id").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    # A split either fixes the state (same end from both starts), keeps it, or flips it.
    fixes = F.col("end_out") == F.col("end_in")
    flip = F.when(fixes, 0).otherwise(F.col("end_out").cast("int"))
    staged = own.withColumn("flips", F.coalesce(F.sum(flip).over(earlier.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    last_fix = F.last(F.when(fixes, F.struct("end_out", "flips")), ignorenulls=True).over(earlier)
    flips_before = F.col("flips") - flip
    base = F.coalesce(last_fix["end_out"], F.lit(False)).cast("int")
    since = flips_before - F.coalesce(last_fix["flips"], F.lit(0))
    known = staged.withColumn("quoted", ((base + since) % 2) == 1)
    begun = F.when(F.col("quoted"), F.col("rows_in")).otherwise(F.col("rows_out"))
    return known.select(
        "file_id", "block_start", "delimiter", "quoted", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("first_row")
    )


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each split: finished ones with their fields, parts of others with their text."""
    current, quoted, row, parts, delimiter, begun_here = None, False, -1, [], ",", False
    out: list[tuple] = []

    def flush(finished: bool) -> None:
        # What ends a finished record's last line is no part of it; the part of an unfinished one keeps it.
        text = "".join(parts[:-1] if finished else parts)
        whole = finished and begun_here
        out.append((current[0], row, current[1], delimiter, None if whole else text, split_fields(text, delimiter) if whole else None))

    def table() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["file_id", "row_idx", "block_start", "delimiter", "record", "fields"])

    for split, run in _split_runs(batches):
        if split != current:
            if parts:
                flush(False)
            current, parts = split, []
            quoted, delimiter = bool(run["quoted"].iat[0]), run["delimiter"].iat[0]
            row, begun_here = int(run["first_row"].iat[0]) - 1, False
        for line, ended in zip(run["value"], run["line_end"]):
            if not quoted:
                row, begun_here = row + 1, True
            parts += (line, ended)
            if '"' in line:
                quoted = ends_quoted(line, quoted, delimiter)
            if not quoted:
                flush(True)
                parts = []
        if out:
            yield table()
            out = []
    if parts:
        flush(False)
        yield table()


def cell_kind(raw: Column) -> Column:
    """What a text cell holds, by its look: number, boolean, string, or nothing."""
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(raw.rlike(NUMBER_TEXT), "number")
        .when(raw.isin("TRUE", "FALSE"), "boolean")
        .otherwise("string")
    )


def cells_of(fields: Column) -> Column:
    return F.transform(fields, lambda raw: F.struct(raw.alias("raw"), cell_kind(raw).alias("kind")))


def read_grid(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All records of the files as grid rows."""
    # One row a file.
    probed = stored(probe(spark, paths))
    lines = _lines(spark, paths, probed)
    # Writing the summaries keeps the first pass to one run and tells the planner their size.
    folder = shared_folder(spark)
    lines.mapInPandas(_summarise, _SUMMARY).write.parquet(folder)
    splits = _placed_splits(spark.read.schema(_SUMMARY).parquet(folder), probed)
    keys = ["file_id", "block_start"]
    # One short row a split. What Python reads has no size that the planner knows: left to itself it would broadcast the lines.
    placed = lines.join(F.broadcast(splits), keys).sortWithinPartitions(*keys, "line_no")
    columns = ["file_id", "block_start", "value", "line_end", "delimiter", "quoted", "first_row"]
    pieces = placed.select(*columns).mapInPandas(_cut, _PIECES)
    whole = pieces.where(F.col("fields").isNotNull()).select("file_id", "row_idx", "fields")
    # Records crossing splits: a part per split, joined in order and cut like the others.
    crossing = (
        pieces.where(F.col("fields").isNull())
        .groupBy("file_id", "row_idx")
        .agg(F.array_sort(F.collect_list(F.struct("block_start", "record"))).alias("parts"), F.min("delimiter").alias("delimiter"))
        .select("file_id", "row_idx", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"), "delimiter")
        .mapInPandas(_cut_crossing, "file_id string, row_idx bigint, fields array<string>")
    )
    rows = whole.unionByName(crossing)
    return rows.select("file_id", F.lit(SHEET).alias("sheet"), "row_idx", cells_of(F.col("fields")).alias("cells"))


def _cut_crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fields = [split_fields(r, d) for r, d in zip(batch["record"], batch["delimiter"])]
        yield pd.DataFrame({"file_id": batch["file_id"], "row_idx": batch["row_idx"], "fields": fields})


def grid_from_cells(cells: DataFrame) -> DataFrame:
    """Grid rows from a cell table ``(file_id, sheet, row_idx, col_idx, raw, kind)``; gaps become empty cells.

    Of several cells at one place the last by ``(raw, kind)`` stays.
    """
    entries = F.array_sort(F.collect_list(F.struct("col_idx", F.struct("raw", "kind").alias("cell"))))
    empty = F.struct(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("kind"))
    rows = cells.groupBy("file_id", "sheet", "row_idx").agg(entries.alias("entries"), F.max("col_idx").alias("last"))
    last_here = F.filter("entries", lambda e, i: F.coalesce(F.get("entries", i + 1)["col_idx"] != e["col_idx"], F.lit(True)))
    rows = rows.withColumn("found", F.map_from_entries(last_here))
    filled = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("found", i), empty))
    return rows.select("file_id", "sheet", "row_idx", filled.alias("cells"))


def grid_cells(grid: DataFrame) -> DataFrame:
    """The cell table of grid rows."""
    return grid.select("file_id", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "cell")).select(
        "file_id", "sheet", "row_idx", "col_idx", "cell.raw", "cell.kind"
    )
