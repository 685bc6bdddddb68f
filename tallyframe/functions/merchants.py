"""From a printed descriptor to a merchant key, as column expressions.

Six stages, in order: characters, processor prefixes, store numbers, places and contacts,
references, tidying. Each is a function of a column; :func:`stages` chains them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Processor prefixes, tried in this order.
PREFIXES = ["DEBIT CARD PURCHASE", "RECURRING PMT", "POS DEBIT", "ACH DEBIT", "PAYPAL *", "WWW.", "TST*", "SQ *", "PP*", "IN *", "SP "]
# Places that end a descriptor.
STATES = """AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY
DC PR VI GU AS MP""".split()
COUNTRIES = ["USA", "US", "CAN", "GBR", "MEX"]
# Prefixes whose tail is a person.
PERSONS = ["ZELLE", "VENMO", "CASH APP", "SQUARE CASH", "CHECK #", "CHECK#"]
# What the stages take out, each replaced by the text beside it.
STORES = [(r"\s*#\s*\d+", " "), (r"\b(?:STORE|STR|TERM|TERMINAL|LOC|UNIT)\s*#?\s*\d+\b", " "), (r"\b\d{6,}\b", " "), (r"\s+\d{3,5}\s*$", " ")]
CONTACTS = [(r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", " "), (r"\bHTTPS?://", " "), (r"\bWWW\.", " "), (r"\b([A-Z0-9-]+)\.(?:COM|NET|ORG|CO|IO|US|GOV|EDU)\b(?:/\S*)?", "$1")]
REFERENCES = [
    (r"\b(?:REF|TRACE|AUTH|CONF|INV|TRAN|ID)\b\s*#?\s*(?=[A-Z0-9-]*\d)[A-Z0-9-]+", " "),
    (r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b", " "),
    (r"\s+(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{8,}\s*$", " "),
    (r"\s*\bX{2,}\d+\b", " "),
]
TIDY = [("[^A-Z0-9&' -]", " "), (r"\s*-\s*$", ""), (r"^\s*-\s*", "")]


def _each(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, put in rules:
        c = F.regexp_replace(c, pattern, put)
    return c


def _single(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def characters(c: Column) -> Column:
    """ASCII dashes and quotes, no control characters, upper case, single spaces."""
    c = F.regexp_replace(c, "[‐-―−]", "-")
    c = F.regexp_replace(F.regexp_replace(c, "[‘’‛]", "'"), "[“”]", '"')
    return _single(F.upper(F.regexp_replace(c, r"[\x00-\x1F\x7F ]", " ")))


def without_prefixes(c: Column, prefixes: list[str] = PREFIXES, passes: int = 4) -> Column:
    """Leading prefixes go, up to ``passes`` of them, unless nothing would be left."""
    listed = "|".join(r"\Q" + p + r"\E" for p in prefixes)
    for _ in range(passes):
        c = F.regexp_replace(c, rf"^(?:{listed})\s*(?=\S)", "")
    return c


def without_stores(c: Column) -> Column:
    return _single(_each(c, STORES))


def without_places(c: Column) -> Column:
    """No telephone numbers; of a web address its name stays; trailing states and countries go, but for a lone word."""
    return F.regexp_replace(_single(_each(c, CONTACTS)), rf"(?<=\S)(?: (?:{'|'.join(STATES + COUNTRIES)}))+$", "")


def without_references(c: Column) -> Column:
    return _single(_each(c, REFERENCES))


def tidy(c: Column) -> Column:
    return _single(_each(c, TIDY))


STAGES = [("characters", characters), ("prefixes", without_prefixes), ("stores", without_stores), ("places", without_places), ("references", without_references), ("tidy", tidy)]


def stages(c: Column) -> Column:
    for _, stage in STAGES:
        c = stage(c)
    return c


def trace(c: Column) -> Column:
    """array<struct<stage, name, before, after>> of the six stages."""
    out = []
    for k, (name, stage) in enumerate(STAGES, 1):
        after = stage(c)
        out.append(F.struct(F.lit(k).alias("stage"), F.lit(name).alias("name"), c.alias("before"), after.alias("after")))
        c = after
    return F.array(*out)


def to_person(c: Column, known: list[str] = ()) -> Column:
    """Whether a descriptor pays a person: a listed prefix, or PayPal with a merchant key that is not known."""
    x = characters(c)
    listed = F.lit(False)
    for p in PERSONS:
        listed = listed | x.startswith(p)
    paypal = x.startswith("PAYPAL *") | x.startswith("PP*")
    return listed | (paypal & (~stages(c).isin(*known) if known else F.lit(True)))
