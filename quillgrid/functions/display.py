"""Numbers and cells as shown on a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import coerced_number, fixed, is_numeric
from .text import as_text, neutralise

# Signs printed for a currency code in US English.
CURRENCY_PREFIX = {
    "USD": "$",
    "EUR": "€",
    "GBP": "£",
    "JPY": "¥",
    "INR": "₹",
    "CAD": "CA$",
    "AUD": "A$",
}
# Thousands steps of the compact notation.
COMPACT_UNITS = ["", "K", "M", "B", "T"]


def _grouped(num: Column, places: int) -> Column:
    """Fixed decimals with thousands commas, rounding half away from zero on the written decimal."""
    exact = F.round(num.try_cast(f"decimal(38,{min(places + 8, 18)})"), places)
    return F.coalesce(F.format_number(exact, places), F.format_number(num, places))


def _per_precision(num: Column, precision: int | None, make) -> Column:
    if precision is not None:
        return make(num, precision)
    return F.when(num == F.rint(num), make(num, 0)).otherwise(make(num, 2))


def _compact(num: Column, places: int, fixed: bool) -> Column:
    out = None
    for i, unit in reversed(list(enumerate(COMPACT_UNITS))):
        text = _grouped(num / (1000.0**i), places)
        if not fixed and places > 0:
            text = F.regexp_replace(text, r"\.?0+$", "")
        text = F.concat(text, F.lit(unit))
        # Rounding may reach the next step: 999.96 thousand shown with one decimal is one million.
        fits = F.abs(F.round(num / (1000.0 ** (i - 1)), places)) >= 1000 if i else F.lit(True)
        out = (out.when(fits, text) if out is not None else F.when(fits, text))
    return out


def _scientific(num: Column, places: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{places}e", num), r"e([+-])0(\d)$", "e$1$2")


def display(
    c: Column,
    dtype: T.DataType,
    scale: float = 1.0,
    prefix: str = "",
    suffix: str = "",
    precision: int | None = None,
    notation: str = "standard",
    currency: str | None = None,
) -> Column:
    """The shown text of a cell: numbers formatted, missing as a dash, text guarded against formula evaluation."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("—")).when(c, F.lit("True")).otherwise(F.lit("False"))
    if is_numeric(dtype):
        num, text = c.cast("double") * scale, c.cast("string")
    else:
        text = as_text(c, dtype)
        num = F.when(F.trim(text) != "", coerced_number(text)) * scale if isinstance(dtype, T.StringType) else F.lit(None).cast("double")
    if currency:
        sign = F.when(num < 0, F.lit("-")).otherwise(F.lit(""))
        lead = F.concat(sign, F.lit(CURRENCY_PREFIX.get(currency, currency + " ")))
        body = (lambda n, p: _compact(n, p, True)) if notation == "compact" else _grouped
        shown = F.concat(lead, _per_precision(F.abs(num), precision, body))
    elif notation == "compact":
        shown = _per_precision(num, precision, lambda n, p: _compact(n, p, False))
    elif notation == "scientific":
        shown = _per_precision(num, precision, _scientific)
    else:
        shown = _per_precision(num, precision, _grouped)
    finite_number = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != float("inf"))
    whole = F.concat(F.lit(prefix), F.when(finite_number, shown).otherwise(text), F.lit(suffix))
    return F.when(c.isNull(), F.lit("—")).otherwise(neutralise(whole))


def comparison(value: Column, previous: float | None = None, target: float | None = None, change: str = "percent") -> dict[str, Column]:
    """Difference of a measure from a base value: the previous one if given, else the target; none for a zero base."""
    base = previous if previous is not None else target
    num = value.cast("double")
    if base is None or base == 0:
        nothing = F.lit(None)
        return {"diff": nothing.cast("double"), "pct_change": nothing.cast("double"), "direction": nothing.cast("string"), "change_text": nothing.cast("string")}
    diff = num - F.lit(float(base))
    pct = fixed(diff / F.abs(F.lit(float(base))) * 100, 1)
    sign = F.when(diff > 0, F.lit("+")).otherwise(F.lit(""))
    text = (
        F.concat(sign, F.format_string("%.1f", pct), F.lit("%"))
        if change == "percent"
        else F.concat(sign, display(diff, T.DoubleType()))
    )
    return {
        "diff": diff,
        "pct_change": pct,
        "direction": F.when(diff > 0, "positive").when(diff < 0, "negative").when(diff == 0, "neutral"),
        "change_text": text,
    }
