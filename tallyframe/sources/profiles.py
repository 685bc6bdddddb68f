"""Format profiles: how a bank's files are read, as JSON; loading and checks."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse

#: What a column can be.
ROLES = ["transaction_date", "posted_date", "description", "amount", "debit", "credit", "balance", "status"]


def header_tokens(cells: list[str]) -> list[str]:
    """Header cells as they are compared, as :func:`tallyframe.sources.statements.tokens` has them."""
    plain = lambda c: re.sub("[^a-z0-9 ]", "", re.sub(r"\s+", " ", c.removeprefix("\ufeff").strip().lower())).strip()
    return [plain(c) for c in cells]


def checked(profile: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a profile."""
    errors, warnings, columns = [], [], profile.get("columns", {})
    errors += [f"unknown role {r}" for r in columns if r not in ROLES]
    if "description" not in columns:
        errors.append("a description is needed")
    if not {"transaction_date", "posted_date"} & set(columns):
        errors.append("a date is needed")
    if profile.get("amount_mode", "single") == "single":
        if "amount" not in columns:
            errors.append("an amount is needed")
        if {"debit", "credit"} & set(columns):
            errors.append("debit and credit do not go with a single amount")
    else:
        sides = {"debit", "credit"} & set(columns)
        if not sides:
            errors.append("debit or credit is needed")
        if "amount" in columns:
            errors.append("an amount does not go with debit and credit")
        if len(sides) == 1:
            warnings.append("one of debit and credit is not mapped")
    try:
        parse(F.lit(""), profile.get("date_format", ""))
    except ValueError as e:
        errors.append(str(e))
    if not profile.get("has_header", True):
        errors += [f"{r} names a header, but there is none" for r, c in columns.items() if isinstance(c, str)]
    if len(profile.get("delimiter", ",")) != 1:
        errors.append("a delimiter is one character")
    if "balance" not in columns:
        warnings.append("no balance is mapped, so balances cannot be checked")
    if profile.get("currency", "USD") != "USD":
        errors.append("only USD is supported")
    return errors, warnings


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """path, profile, signature, tokens, body, errors, warnings of every JSON file below a folder; a bad file has errors and stops no other.

    Profiles are small and few; each file is parsed in a task.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "content")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    body = json.loads(bytes(content).decode("utf-8"))
                    if not isinstance(body, dict):
                        raise ValueError("not an object")
                    words = header_tokens(body.get("header", []))
                    rows.append((path, body.get("name"), hashlib.sha256("|".join(words).encode()).hexdigest(), words, json.dumps(body, sort_keys=True), None))
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "profile", "signature", "tokens", "body", "problem"])

    return found.mapInPandas(run, "path string, profile string, signature string, tokens array<string>, body string, problem string")


def valid(loaded_profiles: DataFrame) -> dict[str, dict]:
    """The profiles without errors, by name: the bounded set of formats that a household's banks use."""
    out = {}
    for r in loaded_profiles.where("problem is null").collect():
        body = json.loads(r.body)
        if not checked(body)[0]:
            out[r.profile] = body
    return out
