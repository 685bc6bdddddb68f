"""A ledger's tables in a folder: snapshots swapped as a whole, settings, tombstones, backups.

A snapshot is written to a new folder; then one small manifest file is replaced, which names the
snapshot that counts. A run that fails before that leaves the store as it was.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOMBSTONES = "entity string, entity_id string, deleted_at timestamp"
SETTINGS = "key string, value string"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _current(self) -> str | None:
        try:
            rows = self.spark.read.schema("turn long, name string").json(f"{self.folder}/manifest").orderBy(F.desc("turn"), F.desc("name")).limit(1).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows[0].name if rows else None

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """The named tables of the snapshot that counts."""
        name = self._current()
        if name is None:
            raise LookupError(f"no snapshot in {self.folder}")
        return {n: self.spark.read.parquet(f"{self.folder}/{name}/{n}") for n in names}

    def swap(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables as a new snapshot, then make it count."""
        name = f"snapshot-{uuid.uuid4().hex}"
        for n, df in tables.items():
            df.write.parquet(f"{self.folder}/{name}/{n}")
        try:
            turn = self.spark.read.schema("turn long, name string").json(f"{self.folder}/manifest").agg(F.max("turn")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            turn = 0
        self.spark.createDataFrame([(turn + 1, name)], "turn long, name string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return name

    def backup(self, target: str, *names: str) -> None:
        """The tables that count, as the first snapshot of another store."""
        Store(self.spark, target).swap(self.tables(*names))


def settings_after(settings: DataFrame, new: DataFrame) -> DataFrame:
    """key, value (JSON) with the new values in place."""
    return settings.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def tombstones_since(tombstones: DataFrame, moment) -> DataFrame:
    return tombstones.where(F.col("deleted_at") >= moment)
