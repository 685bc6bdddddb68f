"""Statement files as they arrive: a folder is watched, each file's rows are added to a ledger once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..sources import statements


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every file that comes into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv").load(folder).select("path", "content")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (path, account, key, row_index, ...) with occurrence: how often the file has had the row before, from 0."""
    by = Window.partitionBy("path", "account", "key").orderBy("row_index")
    return rows.withColumn("occurrence", (F.row_number().over(by) - 1).cast("long"))


def follow(spark: SparkSession, folder: str, ledger: str, state: str, profile: dict, account: str, delimiter: str = ",") -> StreamingQuery:
    """Stage the rows of arriving files as the Parquet table ``ledger``, below one folder a batch, with their occurrence in their file.

    A batch that runs again overwrites its own folder, so a lost executor or a restart adds nothing
    twice. Files that overlap, or come again under another name, are staged again here;
    :func:`consume` adds their new rows alone.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = statements.ledger_rows(statements.records(batch, delimiter), profile).where("error is null")
        key = text.dedupe_key(F.lit(account), F.col("date"), F.col("cents"), F.col("description"))
        numbered(rows.withColumns({"account": F.lit(account), "key": key})).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def consume(spark: SparkSession, staged: str, ledger: str, state: str) -> StreamingQuery:
    """Add to the Parquet table ``ledger`` each staged row that it does not have: a file again, under whatever name, adds nothing.

    The nth equal row of any file is the nth equal row of the ledger, as in a merge of two bags: of a
    key, the ledger has as many rows as the file that has most. Which (account, key, occurrence) are
    in is the stream's state, dealt by their hash, so a frequent key spreads over all tasks; it grows
    with the ledger, as rows may come again at any time, and is kept by the session's state store.
    """
    schema = spark.read.parquet(staged).drop("batch").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(staged)
    fresh = rows.dropDuplicates(["account", "key", "occurrence"])
    return fresh.writeStream.format("parquet").outputMode("append").option("path", ledger).option("checkpointLocation", state).trigger(availableNow=True).start()
