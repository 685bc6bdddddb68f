"""Driver tables read as ledgers: one row a transaction, money in signed cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, account, date, cents, merchant: sign-ups and views come in, other events go out."""
    c = cents(F.col("value"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("account"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type").isin("signup", "view"), c).otherwise(-c).alias("cents"),
        F.col("user_id").alias("merchant"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, date, cents, merchant, category, pending: every order goes out."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        (-cents(F.col("o_totalprice"))).alias("cents"),
        F.col("o_custkey").alias("merchant"),
        F.col("o_orderpriority").alias("category"),
        (F.col("o_orderstatus") == "P").alias("pending"),
    )
