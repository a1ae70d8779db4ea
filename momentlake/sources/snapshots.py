"""Tables as snapshot folders: every write makes a new one, readers hold on to the one they opened."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SnapshotTable:
    """A folder of snapshots and a log of which one counts; the log is a table too, its last row wins."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, folder string").json(f"{self.path}/log")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def latest(self) -> tuple[int, str | None]:
        log = self._log()
        row = log.agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version")).first() if log is not None else None
        return (row.version, row.folder) if row and row.folder else (0, None)

    def read(self) -> DataFrame:
        folder = self.latest()[1]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], self.schema)

    def overwrite(self, rows: DataFrame) -> None:
        """The snapshot is complete before the log names it."""
        version, folder = self.latest()[0] + 1, f"data-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder")).write.mode("append").json(f"{self.path}/log")

    def upsert(self, rows: DataFrame, key: str = "id") -> None:
        self.overwrite(upserted(self.read(), rows, key))

    def insert_absent(self, rows: DataFrame, key: str) -> None:
        self.overwrite(self.read().unionByName(absent(self.read(), rows, key)))

    def remove(self, condition: str) -> int:
        """Drops the rows that meet the condition and says how many."""
        now = self.read()
        n = now.filter(condition).count()
        if n:
            self.overwrite(now.filter(~F.coalesce(F.expr(condition), F.lit(False))))
        return n

    def clear(self) -> int:
        """Drops all rows and says how many there were; other tables stay as they are."""
        n = self.read().count()
        self.overwrite(self.read().limit(0))
        return n


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows, replaced or joined by new ones with their key; of new rows with one key, one is taken."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_new"), *[F.col(c) for c in new.columns if c != key and new.schema[c].dataType.typeName() not in ("map", "variant")]))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n", "_new")


def absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not in old, one for each key."""
    first = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c) for c in new.columns if new.schema[c].dataType.typeName() not in ("map", "variant")]))
    return new.withColumn("_n", first).filter("_n = 1").drop("_n").join(old.select(key), key, "left_anti").select(*new.columns)
