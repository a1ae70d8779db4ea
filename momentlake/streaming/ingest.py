"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from momentlake.operators import records
from momentlake.sources.snapshots import SnapshotTable
from momentlake.streaming import keyed


def read_records(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_batches(parts: list[DataFrame], path: str) -> int:
    """Writes each part as the same number of files, which it returns: read_records() with that many files per trigger gives the parts as batches.

    A part is dealt over all cores; where it has too few rows for its files, empty ones are added.
    """
    spark, have = parts[0].sparkSession, 0
    files = max(2, spark.sparkContext.defaultParallelism)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
        now = len(spark.read.schema(part.schema).parquet(path).inputFiles())
        for _ in range(have + files - now):
            spark.createDataFrame([], part.schema).write.mode("append").parquet(path)
        have += files
    return files


def ingest(stream: DataFrame, table: SnapshotTable, checkpoint: str, key: str = "id", after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Upserts each micro-batch by key: a batch that runs twice changes nothing. Stops when all there is has been read; `after` sees each batch."""

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(batch, key)
        if after:
            after(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_counts(events: DataFrame, length: str = "30 seconds", step: str = "25 seconds", late: str = "1 minute") -> DataFrame:
    """Events (ts, event_type, value) per type in overlapping windows; works on streams, later events than `late` are dropped there."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """Each key once, with one of its rows. A stream's state holds the keys; rows that share a key should be equal, as those of deterministic ids are, or else keep_best() says which one counts."""
    return rows.dropDuplicates([key])


def live_categories(chunks: DataFrame, categories: DataFrame, similarity: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Categories (position, name, centre) of the files of a stream of chunks (source_file, ...): the best so far of each file is kept, and a batch's chunks are merged with it."""
    rows = chunks.join(F.broadcast(records.checked_categories(categories)))
    scored = rows.select("source_file", (-similarity).alias("apart"), "position", "name")
    return keyed.keep_best(scored, path, checkpoint, "source_file", ["apart", "position"])


def stored_categories(spark: SparkSession, path: str) -> DataFrame:
    """path, category, score of each file that live_categories() has seen."""
    best = keyed.stored_best(spark, path, "source_file string, apart double, position long, name string", "source_file", ["apart", "position"])
    return best.select(F.col("source_file").alias("path"), F.col("name").alias("category"), (-F.col("apart")).alias("score"))
