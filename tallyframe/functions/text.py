"""Descriptor keys and similarity as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Upper-case letters with a base letter under decomposition, and those base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x2200) if chr(c).isupper()]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folds()


def fold_accents(c: Column) -> Column:
    """Upper-case Latin letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def collapse(c: Column) -> Column:
    """The frozen row key: upper case, no marks, signs to spaces, single spaces, 40 characters."""
    x = F.regexp_replace(fold_accents(F.upper(c)), "[^A-Z0-9 ]", " ")
    x = F.trim(F.regexp_replace(x, " +", " "))
    return F.trim(F.substring(x, 1, 40))


def dedupe_key(account: Column, date: Column, cents: Column, description: Column) -> Column:
    return F.sha2(F.concat_ws("|", account, F.date_format(date, "yyyy-MM-dd"), cents.cast("string"), collapse(description)), 256)


def trigrams(c: Column) -> Column:
    x = F.concat(F.lit("  "), F.trim(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substr(x, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard over sets of trigrams; equal texts are 1."""
    x, y = trigrams(a), trigrams(b)
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
