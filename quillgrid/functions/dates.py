"""Spreadsheet serial dates and dates written in several styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def serial_date(c: Column, system: int = 1900) -> Column:
    """A spreadsheet day number as a date.

    The 1900 system counts a 29 February 1900 that never was, so numbers up to 60 use the later base.
    """
    day = F.floor(c.cast("double")).cast("int")
    if system == 1904:
        return F.date_add(F.to_date(F.lit("1904-01-01")), day)
    if system != 1900:
        raise ValueError("system is 1900 or 1904")
    return F.when(day > 60, F.date_add(F.to_date(F.lit("1899-12-30")), day)).otherwise(
        F.date_add(F.to_date(F.lit("1899-12-31")), day)
    )


def parse_date(c: Column, day_first: bool = False) -> Column:
    """Text in ISO, numeric (month or day first), ``12-Jan-2024`` or ``January 12, 2024`` style as a date.

    Each format is tried only on text of its shape; a numeric date that is impossible in the chosen order is read in
    the other one.
    """
    t = F.regexp_replace(F.trim(c), r"\s+", " ")
    iso = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})(?:[T ].*)?$", 1), "[/.]", "-")
    numeric = F.regexp_replace(F.regexp_extract(t, r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})$", 1), "[/.]", "-")
    numeric = F.regexp_replace(numeric, r"^(\d{1,2}-\d{1,2})-(\d{2})$", "$1-20$2")
    orders = ["d-M-yyyy", "M-d-yyyy"] if day_first else ["M-d-yyyy", "d-M-yyyy"]
    word = F.regexp_replace(F.initcap(F.lower(t)), ",", "")
    # Month names are cut to three letters so that one pattern reads short and long names.
    word = F.regexp_replace(word, r"([A-Z][a-z]{2})[a-z]*", "$1")
    dashed = F.regexp_extract(F.initcap(F.regexp_replace(F.lower(t), "[/-]", " ")), r"^(\d{1,2} [A-Za-z]{3} \d{4})$", 1)

    def tried(col: Column, shape: str, fmt: str) -> Column:
        return F.when(col.rlike(shape), F.to_date(F.try_to_timestamp(col, F.lit(fmt))))

    return F.coalesce(
        tried(iso, r"^\d{4}", "yyyy-M-d"),
        *[tried(numeric, r"^\d", fmt) for fmt in orders],
        tried(dashed, r"^\d", "d MMM yyyy"),
        tried(word, r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
        tried(F.concat(word, F.lit(" 1")), r"^[A-Z][a-z]{2} \d{4} 1$", "MMM yyyy d"),
        tried(F.concat(word, F.lit(" 1")), r"^\d{4} [A-Z][a-z]{2} 1$", "yyyy MMM d"),
    )


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
