"""CSV, TSV and JSON output whose text cells no spreadsheet runs as formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text, neutralise


def _csv_field(c: Column, dtype: T.DataType, guard: bool, separator: str = ",") -> Column:
    """Cells become text first, so a negative number is guarded like any text that begins with a minus."""
    text = as_text(c, dtype)
    text = neutralise(text) if guard else text
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    special = text.rlike(f'[{separator}"\n\r]')
    return F.coalesce(F.when(special, quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame, guard: bool = True, separator: str = ",") -> DataFrame:
    """One RFC 4180 line per row, without line end: quotes where needed, quotes doubled, nulls empty."""
    fields = [_csv_field(F.col(f"`{f.name}`"), f.dataType, guard, separator) for f in df.schema.fields]
    return df.select(F.concat_ws(separator, *fields).alias("line"))


def csv_header(df: DataFrame, guard: bool = True, separator: str = ",") -> str:
    out = []
    for name in df.columns:
        text = "'" + name if guard and name.lstrip()[:1] in tuple("=+-@|") else name
        out.append('"' + text.replace('"', '""') + '"' if any(x in text for x in (separator, '"', "\n", "\r")) else text)
    return separator.join(out)


def write_csv(
    df: DataFrame, folder: str, header: bool = True, guard: bool = True, separator: str = ",", mode: str = "errorifexists", line_end: str = "\r\n", utf16: bool = False
) -> None:
    """CSV files. Every part file gets the header, as Spark's own CSV writer does, and in UTF-16 (little-endian) a byte-order mark.

    Lines are built here because Spark's CSV writer with CRLF also rewrites line breaks inside quoted fields.
    """
    lines = csv_lines(df, guard, separator)
    # The lower 33 bits of this id number the rows of a task.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    if header:
        top = csv_header(df, guard, separator)
        lines = lines.select(first.alias("first"), "line").select("first", F.posexplode(F.when(F.col("first"), F.array(F.lit(top), "line")).otherwise(F.array("line"))).alias("n", "line"))
        lines = lines.select((F.col("first") & (F.col("n") == 0)).alias("first"), "line")
    elif utf16:
        lines = lines.select(first.alias("first"), "line")
    if utf16:
        # The text writer writes a string's bytes as they are.
        marked = F.concat(F.when(F.col("first"), F.lit("\ufeff")).otherwise(F.lit("")), "line")
        lines = lines.select(F.encode(marked, "UTF-16LE").cast("string").alias("line"))
        line_end = line_end.encode("utf-16-le").decode()
    lines.select("line").write.mode(mode).option("lineSep", line_end).text(folder)


def write_tsv(df: DataFrame, folder: str, header: bool = True, guard: bool = True, mode: str = "errorifexists") -> None:
    write_csv(df, folder, header, guard, "\t", mode)


def guarded(df: DataFrame) -> DataFrame:
    """Text columns with formulas quoted, all other columns as they are."""
    return df.select(
        *[neutralise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row; missing values stay as null."""
    return guarded(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def write_json(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    guarded(df).write.mode(mode).option("ignoreNullFields", "false").json(folder)
