"""An index as a folder of runs: chunks are appended, letters replaced, and a log says which runs count.

A run writes its chunks, dead letters and ledger to folders of its own and becomes visible by one row of the log, so
that readers see whole runs only; a reader may hold on to a version while later ones are published. One writer at a
time. Nothing stored is written again: a run's work grows with what it adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "id string, source_file string, start_time double, end_time double, embedding array<double>, backend string, model string"
LETTER = "id string, source_file string, start_time double, end_time double, error string, attempts long, last_attempt long"
LEDGER = "id string, source_file string, segment long, start_time double, end_time double, status string, error string, attempts long"
_LOG = "version long, run string, batch string"


class IndexStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """version, run, batch (what the writer calls it) of all published runs."""
        try:
            return self.spark.read.schema(_LOG).json(f"{self.path}/log")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _LOG)
            raise

    def version(self) -> int:
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _runs(self, version: int | None) -> list[str]:
        rows = self.log() if version is None else self.log().filter(F.col("version") <= version)
        return [r.run for r in rows.orderBy("version").collect()]  # a row for each run

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks of all runs up to a version, or of all that are published now."""
        return self._read(CHUNK, [f"{run}/chunks" for run in self._runs(version)])

    def letters(self, version: int | None = None) -> DataFrame:
        return self._read(LETTER, [f"{run}/letters" for run in self._runs(version)[-1:]])

    def ledger(self, version: int) -> DataFrame:
        """id, source_file, segment, start_time, end_time, status, error, attempts: a row for each span that the run of that version was asked for."""
        return self._read(LEDGER, [f"{run}/ledger" for run in self._runs(version)[-1:]])

    def has_batch(self, batch: str) -> bool:
        return not self.log().filter(F.col("batch") == batch).isEmpty()

    def new_run(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def write(self, run: str, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{run}/{name}")

    def publish(self, run: str, batch: str | None = None) -> int:
        """Makes a run count, once its chunks, letters and ledger are written."""
        version = self.version() + 1
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(run).alias("run"), F.lit(batch).cast("string").alias("batch"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/log")
        return version
