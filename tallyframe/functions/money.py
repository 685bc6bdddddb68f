"""Money is signed integer cents; negative leaves the account."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def half_up(x: Column) -> Column:
    """Halves go up, whatever the sign."""
    return F.floor(x + 0.5).cast("long")


def parse(text: Column) -> Column:
    """Cents of a written amount, null where it is not one.

    Parentheses and signs before or after negate, currency marks and spaces are dropped,
    thousands are grouped by commas, at most two decimals.
    """
    t = F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")
    inside = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(F.when(inside, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t), r"(?i)USD|[$\s ]", "")
    before, after = t.rlike("^[+-]"), F.regexp_replace(t, "^[+-]", "").rlike("[+-]$")
    negative = (inside.cast("int") + t.startswith("-").cast("int") + (after & t.endswith("-")).cast("int")) % 2 == 1
    body = F.regexp_replace(F.regexp_replace(t, "^[+-]", ""), "[+-]$", "")
    plain = F.regexp_replace(body, ",", "")
    whole = F.split_part(plain, F.lit("."), F.lit(1))
    part = F.rpad(F.split_part(plain, F.lit("."), F.lit(2)), 2, "0")
    value = F.concat(whole, part).try_cast("long")
    ok = body.rlike(r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{1,2})?$") & (value <= 2**53 - 1)
    return F.when(ok, F.when(negative, -value).otherwise(value))


def show(c: Column) -> Column:
    """-$1,234.05"""
    x = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.floor(x / 100), 0), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))


def problem(text: Column) -> Column:
    """Why a written amount cannot be read: empty, too large or not an amount; null where it can."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00a0\ufeff]", "") == ""
    digits = F.length(F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), "[^0-9]", ""))
    return F.when(parse(text).isNotNull(), F.lit(None)).when(blank, "empty").when((digits > 13) & ~text.rlike("(?i)[a-z&&[^usd]]"), "too large").otherwise("not an amount")
