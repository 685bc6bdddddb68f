"""Statement dates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a date format, longest first, with what they match.
TOKENS = {"YYYY": r"(\d{4})", "MMM": "([A-Za-z]{3})", "YY": r"(\d{2})", "MM": r"(\d{2})", "DD": r"(\d{2})", "M": r"(\d{1,2})", "D": r"(\d{1,2})"}
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
PIVOT = 70  # two-digit years from here on are of the last century


def parse(text: Column, fmt: str) -> Column:
    """The date written in ``fmt``, null where the text does not match or no such day exists."""
    parts = re.findall("YYYY|MMM|YY|MM|DD|M|D|.", fmt, re.S)
    kinds = [p for p in parts if p in TOKENS]
    if sorted(k[0] for k in kinds) != ["D", "M", "Y"]:
        raise ValueError(f"a date format needs a year, a month and a day: {fmt}")
    pattern = "^" + "".join(TOKENS.get(p) or re.escape(p) for p in parts) + "$"
    t = F.trim(text)
    got = {k: F.regexp_extract(t, pattern, n) for n, k in enumerate(kinds, 1)}
    year = month = day = None
    for k, c in got.items():
        n = c.try_cast("int")
        if k == "YYYY":
            year = n
        elif k == "YY":
            year = F.when(n >= PIVOT, 1900 + n).otherwise(2000 + n)
        elif k == "MMM":
            at = F.position(F.upper(c), F.lit(MONTHS))
            month = F.when((F.length(c) == 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))
        elif k[0] == "M":
            month = n
        else:
            day = n
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    whole = year.isNotNull() & month.between(1, 12) & day.between(1, 31)
    return F.when(whole, F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def is_iso(text: Column) -> Column:
    """Whether the text is a calendar day as YYYY-MM-DD."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def effective(transaction: Column, posted: Column) -> Column:
    return F.coalesce(transaction, posted)
