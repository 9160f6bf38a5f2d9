"""Word lists and patterns of column inference. All are fixed values; words match as substrings of the name."""

from __future__ import annotations

import re

# Words of measures that are counted or rated, never money.
NOT_MONEY = "days lead_days count quantity qty units score rating duration multiplier level weeks year".split()

# Words of money columns.
MONEY = """
salary revenue budget actual variance price cost spend rate_usd rate_eur expense margin net_position total_amount amount
annual_target bonus_allocation contract_value gross caf_co_t_eur standard_cost subtotal tax_amount grand_total
total_estimated_cost total_cost_usd annual_salary unit_cost figure usd eur gbp inr cad aud chf jpy
""".split()

# Words of category columns.
CATEGORY = """
country department region status stage strategic_priority priority channel unit format_type tier severity category
trade_section unit_of_measure delivery_status requester state col_4 account_tier order_status quality_flag security_level
txn_type currency
""".split()

# Words of free-text columns.
FREE_TEXT = """
name desc description text comment summary log note feedback handle manager owner auditor lead_auditor city location
preferred_vendor reading_value national_id lead
""".split()

# Words of identifier columns for type inference.
IDENTIFIER = """
_id id code sku ref key po_number submission_id part_number col_1 _no account_no acct_no item_ref uuid
""".split()

# Words of identifier columns for role assignment.
IDENTIFIER_ROLE = "id _id key _key sku code ref uuid account_no po_number".split()

# Words of time columns for role assignment.
TIME_ROLE = """
date time timestamp datetime year quarter month day week period epoch created updated closed opened completed started
resolved shipped due deadline dob birthday timeline hired
""".split()

# Words of duration measures, which are not time axes.
DURATION_ROLE = """
duration lead_days days_to elapsed latency cycle_time response_time days_open lead_time hours_spent
""".split()

# Words that keep a measure out of an automatic report, and the durations that stay in.
REPORT_TIME = "date time timestamp year quarter month day created updated closed opened completed due".split()
REPORT_DURATION = "duration lead_days days_to elapsed latency hours_spent".split()

# Words that make a column temporal when a question is read.
QUESTION_TIME = "date time timestamp year month day quarter created updated due closed".split()

# Name words of each rule of type inference.
PERCENT_IF_EMPTY = "pct percent growth".split()
PERCENT = "pct percent growth discount_rate tax_rate".split()
DATE_IF_EMPTY = "date time".split()
MONEY_IF_EMPTY = "salary cost price budget revenue amount".split()
SERIAL_DATE = "serial date time timestamp epoch launch created updated closed due".split()
NUMERIC_ID = "store_id ticket_id account_no record_id".split()

# Words read as true or false.
TRUTH_WORDS = "true false yes no True False".split()
BINARY_WORDS = "0 1 true false".split()

# Currency codes, and the sign that stands for each.
CURRENCY_CODES = "USD EUR GBP JPY INR CHF CAD AUD".split()
CURRENCY_OF_SIGN = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}

# Shapes of cells.
PERCENT_CELL = r"^-?[\d,]+(?:\.\d+)?\s*%$"
ISO_DATE_CELL = (
    r"^\d{4}[/.-]\d{1,2}[/.-]\d{1,2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
OTHER_DATE_CELL = (
    r"^(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}[/-][A-Za-z]{3}[/-]\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"
    r"|\d{4}\s+[A-Za-z]{3,9}|[A-Za-z]{3,9}\s+\d{4})$"
)
CURRENCY_CELL = (
    r"(?i)^[$€£¥₹]|[$€£¥₹]$|^\((?:[$€£¥₹]\s*)?[\d,]+(?:\.\d+)?\)$"
    r"|^(?:USD|EUR|GBP|JPY|INR|CHF|CAD|AUD)\s+|\s+(?:USD|EUR|GBP|JPY|INR|CHF|CAD|AUD)$"
)
CURRENCY_CODE_WORD = r"(?i)\b(USD|EUR|GBP|JPY|INR|CHF|CAD|AUD)\b"
CODE_CELL = r"^[A-Za-z0-9_.-]+$"
CODE_PART = r"[A-Za-z]+[-_][0-9]+"

# Rows that add up others, and notes under a table.
SUBTOTAL_CELL = r"(?i)(?:^|\s)(?:total|subtotal|sub-total|grand\s*total|sum|average|avg)\b"
FOOTNOTE_CELL = r"(?i)^\s*(?:\*|note[s]?:|source:|confidential|copyright|unaudited|disclaimer:)"


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words anywhere."""
    return "|".join(re.escape(w) for w in words)
