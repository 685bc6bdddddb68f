"""A training-data pipeline of corpus operators, from documents to packed sequences.

Every stage works on all rows that its predecessor kept; its result is written as Parquet and
read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import minhash, packing, quality, secrets, toxicity
from tallyframe.llm.common import stored
from tallyframe.llm.queries import ledger, vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7 stay; a null or empty text has the base score and stays."""
    return toxicity.accepted(docs, _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more stay; a null or empty text is scored like any other."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of word shingles from 0.8 on) stays, the one of least doc_id."""
    return minhash.dedup(docs, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text; n_chars follows where the table has it. A null text stays null."""
    out = secrets.redact(docs, ledger(spark))
    return out.selectExpr(*("cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in out.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is the closing id alone."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifiers and the tokenizer have no SQL. Tests check the stages' columns and counts, and their operators by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
