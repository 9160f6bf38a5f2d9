"""From grid rows to tables: merged cells, header rows, column keys, noise rows, clean cells.

Every step is keyed by (file_id, sheet), but none gathers a sheet: header detection looks at the first 26 rows, row
tests need one row each, and what a whole sheet must agree on (its last data row, its empty columns) is an aggregate
that combines where the rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import NUMBER_TEXT
from ..functions.text import header_keys, trimmed, unique_keys
from ..session import stored

SHEET_KEY = ["file_id", "sheet"]
ROW_KEY = [*SHEET_KEY, "row_idx"]

# Fixed values of header detection.
LAST_CANDIDATE, HEAD_ROWS, LOOK_AHEAD = 20, 26, 5
HEADER_LENGTH, NOTE_LENGTH, SUBTOTAL_LENGTH = 256, 30, 60

# Ranges of a sheet that its rows may carry as one array; sheets with more meet their rows in blocks.
FEW_RANGES = 16


# Text that reads as a number, radix literals included.
_NUMERIC_LOOK = NUMBER_TEXT + "|^0[xX][0-9a-fA-F]+$|^0[oO][0-7]+$|^0[bB][01]+$"


def _texts(cells: Column) -> Column:
    """The trimmed text of every cell, empty where there is none."""
    return F.transform(cells, lambda c: trimmed(F.coalesce(c["raw"], F.lit(""))))


# The tests of rows below take the texts and ask most of them by functions of whole arrays and of the joined text: a
# lambda runs cell by cell, uncompiled, and computes nothing once for two uses.


def _filled(texts: Column) -> Column:
    """The texts of the non-blank cells of a row."""
    return F.array_remove(texts, "")


def _is_subtotal(texts: Column) -> Column:
    # Cells are trimmed and a line feed is white space, so what a cell has at its start the joined text has after a space.
    may_be = F.array_join(texts, "\n").rlike(V.SUBTOTAL_CELL)
    return may_be & F.exists(texts, lambda t: (F.length(t) < SUBTOTAL_LENGTH) & t.rlike(V.SUBTOTAL_CELL))


def _is_worded(texts: Column) -> Column:
    return F.get(_filled(texts), 0).rlike(V.FOOTNOTE_CELL)


def _is_lone(texts: Column, kinds: Column) -> Column:
    first = F.get(_filled(texts), 0)
    kind = F.get(kinds, (F.array_position(texts, first) - 1).cast("int"))
    return (F.size(_filled(texts)) == 1) & (F.length(first) > NOTE_LENGTH) & (kind == "string")


def _is_footnote(texts: Column, kinds: Column, total_columns: Column) -> Column:
    """Narrow tables need the words of a note; wider ones also take a lone long text cell in a mostly empty row."""
    filled = F.size(_filled(texts))
    sparse = filled / F.greatest(total_columns, F.lit(1)) <= 0.4
    worded = _is_worded(texts)
    return (filled > 0) & F.when(total_columns <= 2, worded).otherwise(sparse & (worded | _is_lone(texts, kinds)))


def row_flags(grid: DataFrame, total_columns: Column) -> DataFrame:
    """Grid rows with the texts of their cells and whether they are blank, a subtotal or a footnote."""
    rows = grid.withColumn("texts", _texts(F.col("cells")))
    return rows.select(
        "*",
        (F.size(_filled(F.col("texts"))) == 0).alias("is_blank"),
        _is_subtotal(F.col("texts")).alias("is_subtotal"),
        F.coalesce(_is_footnote(F.col("texts"), F.col("cells")["kind"], total_columns), F.lit(False)).alias("is_footnote"),
    )


# --- merged cells


def _merge_sources(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges whose top-left cell exists, with that cell."""
    top = grid.select(*SHEET_KEY, F.col("row_idx").alias("start_row"), F.col("cells").alias("top_cells"))
    found = merges.join(top, [*SHEET_KEY, "start_row"])
    return found.where(F.col("start_col") < F.size("top_cells")).select(
        *merges.columns, F.get("top_cells", F.col("start_col")).alias("value")
    )


def _covering(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points ``(file_id, sheet, row_idx, ...)`` with every range ``(file_id, sheet, start_row, end_row, ...)`` over their row.

    A range is cut into at most ten blocks of rows, aligned to a power of two that fits its length; a point asks for its block at
    every power its sheet uses, which is one power where all ranges are short. So a range costs the same whatever its length, and
    both sides meet by equal keys.
    """
    length = F.col("end_row") - F.col("start_row") + 1
    power = F.greatest(F.floor(F.log2(length.cast("double"))).cast("int") - 2, F.lit(0))
    sized = ranges.where("end_row >= start_row").withColumn("power", power)
    block = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("power"))).cast("long")
    cut = sized.withColumn("block", F.explode(F.sequence(block(F.col("start_row")), block(F.col("end_row")))))
    # One row a sheet that has ranges.
    used = sized.groupBy(*SHEET_KEY).agg(F.collect_set("power").alias("powers"))
    asked = points.join(used, SHEET_KEY).withColumn("power", F.explode("powers")).drop("powers").withColumn("block", block(F.col("row_idx")))
    met = asked.join(cut, [*SHEET_KEY, "power", "block"]).where(F.col("row_idx").between(F.col("start_row"), F.col("end_row")))
    return met.drop("power", "block", "start_row", "end_row")


def _chained_values(merges: DataFrame) -> DataFrame:
    """Values of merges after chaining: a top-left cell inside an earlier merge holds that merge's value.

    Links to the latest such merge are followed by doubling, so a chain of n takes log n rounds, each stored for the next;
    sheets without overlaps, the usual case, take none.
    """
    earlier = merges.select(*SHEET_KEY, "start_row", "end_row", F.col("start_col").alias("from_col"), F.col("end_col").alias("to_col"), F.col("merge_idx").alias("earlier"))
    inside = _covering(merges.select(*SHEET_KEY, F.col("start_row").alias("row_idx"), "start_col", "merge_idx"), earlier).where(
        F.col("start_col").between(F.col("from_col"), F.col("to_col")) & (F.col("earlier") < F.col("merge_idx"))
    )
    links = stored(inside.groupBy(*SHEET_KEY, "merge_idx").agg(F.max("earlier").alias("link")))
    if links.isEmpty():
        return merges
    while True:
        onward = links.select(*SHEET_KEY, F.col("merge_idx").alias("link"), F.col("link").alias("next"))
        followed = stored(links.join(onward, [*SHEET_KEY, "link"], "left").select(*SHEET_KEY, "merge_idx", F.coalesce("next", "link").alias("link"), F.col("next").isNotNull().alias("moved")))
        links = followed.drop("moved")
        if followed.where("moved").isEmpty():
            break
    roots = merges.select(*SHEET_KEY, F.col("merge_idx").alias("link"), F.col("value").alias("root_value"))
    resolved = links.join(roots, [*SHEET_KEY, "link"]).select(*SHEET_KEY, "merge_idx", "root_value")
    return (
        merges.join(resolved, [*SHEET_KEY, "merge_idx"], "left")
        .withColumn("value", F.when(F.col("root_value").isNotNull(), F.col("root_value")).otherwise(F.col("value")))
        .drop("root_value")
    )


def fill_merges(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range takes the range's top-left value; of overlapping ranges the last one wins.

    Ranges are ``(file_id, sheet, merge_idx, start_row, start_col, end_row, end_col)``. The rows of a sheet with few of them take
    them as one array, in a single join by sheet. Sheets with more, or with ranges that start inside an earlier one, meet
    theirs in aligned blocks (``_covering``). Rows that a range names but the sheet lacks cost nothing.
    """
    valued = _merge_sources(grid, merges)
    crowded = stored(merges.groupBy(*SHEET_KEY).count().where(F.col("count") > FEW_RANGES).select(*SHEET_KEY))
    few, many = valued, None
    if not crowded.isEmpty():
        valued = stored(valued)
        few, many = valued.join(crowded, SHEET_KEY, "left_anti"), valued.join(crowded, SHEET_KEY, "left_semi")
    by_sheet = stored(few.groupBy(*SHEET_KEY).agg(_sorted_ranges()).withColumn("chained", _has_chain(F.col("ranges"))))
    if not by_sheet.where("chained").isEmpty():
        chained = by_sheet.where("chained").select(*SHEET_KEY, F.inline("ranges"))
        many = chained if many is None else many.unionByName(chained.select(*many.columns))
        by_sheet = by_sheet.where("not chained")
    out = _laid_over(grid.join(by_sheet.drop("chained"), SHEET_KEY, "left"))
    if many is None:
        return out
    touching = _covering(grid.select(*ROW_KEY), stored(_chained_values(stored(many))))
    touching = touching.withColumns({"start_row": F.col("row_idx"), "end_row": F.col("row_idx")})
    return _laid_over(out.join(touching.groupBy(*ROW_KEY).agg(_sorted_ranges()), ROW_KEY, "left"))


def _sorted_ranges() -> Column:
    place = ["merge_idx", "start_col", "end_col", "value", "start_row", "end_row"]
    return F.array_sort(F.collect_list(F.struct(*place))).alias("ranges")


def _laid_over(rows: DataFrame) -> DataFrame:
    """Rows with the values of ``ranges`` laid over their cells in order, the last one on top."""
    over = F.filter("ranges", lambda r: F.col("row_idx").between(r["start_row"], r["end_row"]))

    def fill(cell: Column, i: Column) -> Column:
        return F.aggregate("ranges", cell, lambda below, r: F.when(i.between(r["start_col"], r["end_col"]), r["value"]).otherwise(below))

    rows = rows.withColumn("ranges", over)
    return rows.withColumn("cells", F.when(F.size("ranges") > 0, F.transform("cells", fill)).otherwise(F.col("cells"))).drop("ranges")


def _has_chain(ranges: Column) -> Column:
    """Whether the top-left cell of a range lies inside an earlier one, among the few ranges of a sheet."""

    def over(r: Column) -> Column:
        return F.exists(
            ranges,
            lambda e: (e["merge_idx"] < r["merge_idx"])
            & r["start_row"].between(e["start_row"], e["end_row"])
            & r["start_col"].between(e["start_col"], e["end_col"]),
        )

    return F.coalesce((F.size(ranges) > 1) & F.exists(ranges, over), F.lit(False))


# --- headers


def _scored_head(grid: DataFrame) -> DataFrame:
    """The first rows of every sheet with their score as a header; null where a row cannot be one."""
    rows = row_flags(grid.where(F.col("row_idx") < HEAD_ROWS), F.size("cells"))
    # A letter a filled cell: word or number as text, other number or label, label of unknown kind.
    numeric = lambda t: t.rlike(_NUMERIC_LOOK)
    letter = lambda t, kind: (
        F.when(t == "", "").when(numeric(t), F.when(kind == "string", "t").otherwise("n")).otherwise(F.when(kind == "string", "w").when(kind.isNull(), "u").otherwise("l"))
    )
    rows = rows.withColumn("look", F.array_join(F.zip_with("texts", F.col("cells")["kind"], letter), ""))
    count = lambda letters: F.length(F.translate("look", "".join(set("tnwul") - set(letters)), ""))
    filled = F.length("look")
    rows = rows.select(
        *ROW_KEY, "is_subtotal", "texts",
        F.size("cells").alias("width"),
        filled.alias("n_filled"),
        count("w").alias("n_words"),
        count("wt").alias("n_texts"),
        count("tnl").alias("n_data"),
        F.size(F.array_distinct(_filled(F.col("texts")))).alias("n_distinct"),
        # Whether the row may be the upper tier of a header below it.
        (~F.col("is_subtotal") & (filled >= 2) & (count("wlu") >= 2)).alias("is_tier"),
    )
    sheet = Window.partitionBy(*SHEET_KEY).orderBy("row_idx")
    whole = sheet.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = sheet.rangeBetween(1, LOOK_AHEAD)
    previous = F.struct("row_idx", F.when(F.col("is_tier"), F.col("texts")).alias("texts"))
    rows = (
        rows.withColumn("sheet_width", F.max("width").over(whole))
        .withColumn("below_filled", F.sum("n_filled").over(ahead))
        .withColumn("below_data", F.sum("n_data").over(ahead))
        .withColumn("previous", F.lag(previous).over(sheet))
    )
    parent = F.when(F.col("previous.row_idx") == F.col("row_idx") - 1, F.col("previous.texts"))
    repeated = F.col("previous.row_idx") == F.col("row_idx")
    rows = rows.withColumn("parent", parent).withColumn("repeated", repeated).drop("previous")
    n, width = F.col("n_filled"), F.col("sheet_width")
    words_share, density = F.col("n_words") / n, F.col("below_data") / F.col("below_filled")
    banner = F.when((n == 1) & (width > 1), 0.75).when((n == 2) & (width >= 4), 0.4).otherwise(0.0)
    turn = F.when((F.col("below_filled") > 0) & (words_share >= 0.5), F.when(density >= 0.25, 0.3 * density)).otherwise(0.0)
    raw = words_share * 0.45 + n / width * 0.25 + F.col("n_distinct") / n * 0.15 + F.coalesce(turn, F.lit(0.0)) * 0.15 - banner
    decay = F.greatest(F.lit(0.1), 1 - F.col("row_idx") * 0.05)
    able = (F.col("row_idx") <= LAST_CANDIDATE) & (n > 0) & ~F.col("is_subtotal") & (F.col("n_texts") > 0)
    return rows.withColumn("score", F.when(able, F.greatest(F.lit(0.0), raw) * decay))


def _sheet_heads(grid: DataFrame) -> DataFrame:
    """One row per sheet: header row, confidence, and a label for every column position (null where there is none)."""
    rows = _scored_head(grid)
    found = F.struct("texts", "parent").alias("head")
    # Two rows of one number have no order: a sheet's head must not depend on it.
    refused = F.raise_error(F.concat(F.lit("two rows with number "), F.col("row_idx").cast("string"), F.lit(" in a sheet"))).cast("int")
    best = rows.groupBy(*SHEET_KEY).agg(
        # Highest score, the earliest row on a tie; without any score the first row.
        F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("row_idx")).alias("up"), found))).alias("best"),
        F.max(F.when(F.col("row_idx") == 0, found)).alias("first"),
        F.max(F.when(F.col("repeated"), refused).otherwise(F.col("sheet_width"))).alias("width"),
    )
    score = F.coalesce(F.col("best.score"), F.lit(0.1))
    best = best.select(
        *SHEET_KEY,
        F.coalesce(-F.col("best.up"), F.lit(0).cast("bigint")).alias("header_row"),
        F.when(F.col("width") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.floor(score * 100 + 0.5) / 100)).alias("confidence"),
        "width",
        F.when(F.col("best").isNotNull(), F.col("best.head")).otherwise(F.col("first")).alias("head"),
    )

    def label(i: Column) -> Column:
        child = F.nullif(F.get(F.col("head.texts"), i), F.lit(""))
        parent = F.nullif(F.get(F.col("head.parent"), i), F.lit(""))
        both = F.when(F.lower(parent) != F.lower(child), F.concat_ws(" ", parent, child))
        return F.coalesce(both, child, parent)

    positions = F.when(F.col("width") > 0, F.sequence(F.lit(0), F.col("width") - 1)).otherwise(F.array().cast("array<int>"))
    return best.select(*SHEET_KEY, "header_row", "confidence", F.transform(positions, label).alias("labels"))


def detect_headers(grid: DataFrame) -> DataFrame:
    """One row per sheet: ``header_row, confidence, original_headers, keys, active_columns``.

    A column without any label is kept only if a row below the header fills it; only such columns are looked up below.
    """
    heads = _sheet_heads(grid).withColumn("open", F.exists("labels", lambda x: x.isNull()))
    # One row a sheet; the keys of sheets with open columns are found again below.
    heads = stored(_named(heads, F.array().cast("array<int>")))
    unsettled = F.col("open") | F.col("repeats")
    if heads.where(unsettled).isEmpty():
        return heads.select(*_HEADER)
    open_columns = heads.where("open").select(*SHEET_KEY, "header_row", F.transform("labels", lambda x: x.isNull()).alias("nameless"))
    rows = grid.join(open_columns, SHEET_KEY).where(F.col("row_idx") > F.col("header_row"))
    # A row is asked for the cells it has, not for all columns of its sheet.
    filled = F.transform("cells", lambda c, i: F.when(F.get("nameless", i) & (trimmed(c["raw"]) != ""), i))
    hits = F.filter(filled, lambda i: i.isNotNull())
    with_data = rows.select(*SHEET_KEY, F.explode(hits).alias("position")).distinct()
    with_data = with_data.groupBy(*SHEET_KEY).agg(F.collect_set("position").alias("filled_nameless"))
    opened = heads.where("open").select(*SHEET_KEY, "header_row", "confidence", "labels", "open").join(with_data, SHEET_KEY, "left")
    opened = _named(opened, F.coalesce("filled_nameless", F.array().cast("array<int>")))
    found = heads.where(~F.col("open")).unionByName(opened.select(*heads.columns))
    # Python sees only headers with repeated keys.
    again = found.where("repeats").withColumn("keys", unique_keys(F.col("keys")))
    return stored(found.where("not repeats").unionByName(again).select(*_HEADER))


_HEADER = [*SHEET_KEY, "header_row", "confidence", "original_headers", "keys", "active_columns"]


def _named(heads: DataFrame, filled_nameless: Column) -> DataFrame:
    """Heads with the names and keys of the columns kept, and whether keys repeat."""
    labelled = F.filter(F.transform("labels", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    positions = F.sort_array(F.concat(labelled, filled_nameless))
    kept = F.transform(positions, lambda i: F.struct(F.get("labels", i).alias("label"), i.alias("position")))
    only = F.array(F.struct(F.lit("Column 1").alias("label"), F.lit(0).alias("position")))
    found = heads.withColumn("kept", kept).withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")).otherwise(only))
    names = F.transform(
        "kept",
        lambda c: F.substring(F.coalesce(c["label"], F.concat(F.lit("Column "), (c["position"] + 1).cast("string"))), 1, HEADER_LENGTH),
    )
    found = found.withColumn("original_headers", names).withColumn("keys", header_keys(F.col("original_headers")))
    return found.select(
        *SHEET_KEY, "header_row", "confidence", "labels", "open", "original_headers", "keys",
        F.transform("kept", lambda c: c["position"]).alias("active_columns"),
        (F.size(F.array_distinct("keys")) < F.size("keys")).alias("repeats"),
    )


# --- rows


def _note_sheets(grid: DataFrame) -> DataFrame:
    """Sheets with a row that may be a footnote, whatever their number of columns."""
    # Only rows with as much text as a lone note, or with a sign or word of one, are asked in full.
    joined = F.array_join(F.col("cells")["raw"], "\n")
    rows = grid.where((F.length(joined) > NOTE_LENGTH) | joined.rlike(V.FOOTNOTE_CELL.replace("^", "")))
    rows = rows.withColumn("texts", _texts(F.col("cells")))
    may_be = F.array(_is_worded(F.col("texts")) | _is_lone(F.col("texts"), F.col("cells")["kind"]))
    # Exploded, not filtered, so that the texts are found once.
    return rows.select(*SHEET_KEY, F.explode(may_be).alias("may_be")).where("may_be").select(*SHEET_KEY).distinct()


def data_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header without blank, subtotal and trailing footnote rows; footnotes between data rows stay.

    Only sheets with footnotes are asked for their last data row.
    """
    wanted = headers.select(*SHEET_KEY, "header_row", "keys", "active_columns")
    # No hint: one row per sheet may be few or millions; Spark broadcasts by measured size or splits skewed sheets.
    flagged = lambda rows: row_flags(rows.join(wanted, SHEET_KEY).where(F.col("row_idx") > F.col("header_row")), F.size("keys"))
    wanted_rows = flagged(grid)
    keep = ~F.col("is_blank") & ~F.col("is_subtotal")
    noted = stored(_note_sheets(grid))
    if not noted.isEmpty():
        of_noted = flagged(grid.join(noted, SHEET_KEY, "left_semi"))
        last = of_noted.groupBy(*SHEET_KEY).agg(F.max(F.when(~F.col("is_blank") & ~F.col("is_footnote"), F.col("row_idx"))).alias("last_row"))
        wanted_rows = wanted_rows.join(last, SHEET_KEY, "left")
        keep = keep & (~F.col("is_footnote") | F.coalesce(F.col("row_idx") <= F.col("last_row"), F.lit(False)))
    # Exploded, not filtered: a filter moves below the columns it reads and finds the texts again for each.
    return wanted_rows.select("*", F.explode(F.when(keep, F.array(F.lit(True)))).alias("kept")).drop("kept")


def records(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """``(file_id, sheet, row_idx, record)`` with the clean cells of each data row by column key."""
    values = F.transform("active_columns", lambda i: F.nullif(F.get("texts", i), F.lit("")))
    rows = data_rows(grid, headers)
    return rows.select(*ROW_KEY, F.map_from_arrays("keys", values).alias("record"))


def to_table(found: DataFrame, keys: list[str]) -> DataFrame:
    """Records of one schema as a table of text columns, still keyed by sheet and row."""
    return found.select(*ROW_KEY, *[F.col("record")[k].alias(k) for k in keys])


def normalise_grid(grid: DataFrame, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Headers and records of every sheet. The grid is read several times: give a stored one when it is large.

    Headers, one row per sheet, come stored from ``detect_headers``.
    """
    if merges is not None:
        grid = fill_merges(grid, merges)
    headers = detect_headers(grid)
    return headers, records(grid, headers)


