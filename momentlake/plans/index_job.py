"""The index build as one job: spans of media, what is known of them, embedding, a ledger, and its report.

A run gives every span one status. `skipped`: its chunk is stored, or it failed before and failed ones are not tried
again; `still`: nothing moves in it; `new`: its vector is stored now; `failed`: a dead letter says why. Media without a
duration have one span, at zero, that fails. The ledger holds the statuses; counts are taken while it is written. A
second run over the same media adds nothing; a run that was stopped leaves nothing behind but unnamed folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from momentlake.functions.moments import chunk_id, fixed_windows
from momentlake.functions.text import short_error
from momentlake.functions.vectors import is_valid, l2_normalize
from momentlake.plans.ingest import Embedder, check_compatible, dead_letters, embed_wanted
from momentlake.sources.index_store import IndexStore

STATUSES = ("new", "skipped", "still", "failed")


@dataclass(frozen=True)
class IndexConfig:
    dimension: int
    backend: str
    model: str
    chunk_ms: int = 30_000
    overlap_ms: int = 5_000
    attempts: int = 3
    batch: int = 64
    retry_failed: bool = False


@dataclass(frozen=True)
class Report:
    """Counts of a run; files_indexed: those with new chunks; total_chunks: what the store holds after it."""

    files: int
    files_indexed: int
    chunks_new: int
    chunks_skipped: int
    chunks_still: int
    chunks_failed: int
    chunks: int
    total_chunks: int
    version: int


def expected_spans(media: DataFrame, config: IndexConfig) -> DataFrame:
    """id, source_file, segment, start_time, end_time, payload, readable of media (source_file, duration_ms, payload)."""
    readable = F.coalesce(F.col("duration_ms") > 0, F.lit(False))
    none = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms")))
    windows = fixed_windows(F.col("duration_ms").cast("long"), config.chunk_ms, config.overlap_ms).cast("array<struct<i:long,start_ms:long,end_ms:long>>")
    each = media.select("source_file", "payload", readable.alias("readable"), F.explode(F.when(readable, windows).otherwise(none)).alias("w"))
    rows = each.select("source_file", F.col("w.i").alias("segment"), (F.col("w.start_ms") / 1000.0).alias("start_time"), (F.col("w.end_ms") / 1000.0).alias("end_time"), F.concat_ws(":", "payload", F.col("w.i").cast("string")).alias("payload"), "readable")
    return rows.select(chunk_id(F.col("source_file"), F.col("start_time")).alias("id"), *rows.columns)


def planned(spans: DataFrame, stored: DataFrame, letters: DataFrame, still: DataFrame | None, config: IndexConfig) -> DataFrame:
    """Spans, each once, with a status: todo, or skipped, still or failed at once. All joins are by id, after one shuffle of the spans."""
    has = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    rows = spans.dropDuplicates(["id"]).join(has(stored, "stored"), "id", "left").join(has(letters, "letter"), "id", "left")
    rows = rows.join(has(still, "is_still"), "id", "left") if still is not None else rows.withColumn("is_still", F.lit(None).cast("boolean"))
    known = F.col("stored").isNotNull() if config.retry_failed else F.col("stored").isNotNull() | F.col("letter").isNotNull()
    status = F.when(known, "skipped").when(~F.col("readable"), "failed").when(F.col("is_still").isNotNull(), "still").otherwise("todo")
    return rows.withColumn("status", status).drop("stored", "letter", "is_still")


def counts() -> list:
    """Aggregates of a ledger: spans by status and in all."""
    return [*(F.count_if(F.col("status") == s).alias(f"chunks_{s}") for s in STATUSES), F.count(F.lit(1)).alias("chunks")]


def run_index(media: DataFrame, store: IndexStore, embedder: Embedder, config: IndexConfig, still: DataFrame | None = None, now: int = 0, batch: str | None = None) -> Report:
    """Indexes media (source_file, duration_ms, payload) into the store and says what became of them.

    still: the ids of spans in which nothing moves; now: what dead letters call the time. Raises ValueError if the
    store holds vectors of another backend or model.
    """
    stored, letters = store.chunks(), store.letters()
    check_compatible(stored, config.backend, config.model)
    plan = planned(expected_spans(media, config), stored, letters, still, config)
    done = embed_wanted(plan, "payload", F.col("status") == "todo", embedder, config.attempts, config.batch)
    good = is_valid(F.col("vector"), config.dimension)
    status = F.when(F.col("status") != "todo", F.col("status")).when(good, "new").otherwise("failed")
    error = F.when(status == "failed", short_error(F.coalesce("error", F.when(F.col("status") == "failed", "file not found").otherwise("invalid vector"))))
    run, seen = store.new_run(), Observation("statuses")
    rows = done.select(*(c for c in done.columns if c not in ("status", "error", "attempts")), status.alias("status"), error.alias("error"), F.when(status == "failed", F.greatest("attempts", F.lit(1))).otherwise(F.col("attempts")).cast("long").alias("attempts"))
    store.write(run, "work", rows.observe(seen, *counts()))
    work = store.spark.read.schema(rows.schema).parquet(f"{store.path}/{run}/work")
    store.write(run, "ledger", work.select("id", "source_file", "segment", "start_time", "end_time", "status", "error", "attempts"))
    store.write(run, "chunks", work.filter("status = 'new'").select("id", "source_file", "start_time", "end_time", l2_normalize(F.col("vector")).alias("embedding"), F.lit(config.backend).alias("backend"), F.lit(config.model).alias("model")))
    failed = work.filter("status = 'failed'").select("id", "source_file", "start_time", "end_time", "error", "attempts", F.lit(now).cast("long").alias("last_attempt"))
    left = letters.join(work.filter("status = 'new'").select("id"), "id", "left_anti") if config.retry_failed else letters
    store.write(run, "letters", dead_letters(left, failed))
    files = work.groupBy("source_file").agg(F.max((F.col("status") == "new").cast("int")).alias("new")).agg(F.count("*").alias("n"), F.coalesce(F.sum("new"), F.lit(0)).alias("new")).first()
    version = store.publish(run, batch)
    return Report(files.n, files.new, **seen.get, total_chunks=store.chunks(version).count(), version=version)


def report_row(report: Report) -> dict:
    return asdict(report)


class Cancelled(Exception):
    """Raised between batches."""


@dataclass(frozen=True)
class StreamReport:
    reports: list[Report]
    cancelled: bool


def run_index_stream(media: DataFrame, store: IndexStore, embedder: Embedder, config: IndexConfig, checkpoint: str, should_cancel: Callable[[], bool] = lambda: False, still: DataFrame | None = None) -> StreamReport:
    """Indexes a stream of media in micro-batches until all there is has been read, or should_cancel says so before a batch.

    A run is named after its batch, so a batch that was published before the stream could note it is not run again;
    after a cancellation, or a crash in a batch, the next call goes on with that batch.
    """
    reports: list[Report] = []
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def write(batch: DataFrame, number: int) -> None:
        key = f"{name}:{number}"
        if store.has_batch(key):
            return
        if should_cancel():
            raise Cancelled
        reports.append(run_index(batch, store, embedder, config, still, number, key))

    query = media.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "Cancelled" not in str(e):
            raise
        return StreamReport(reports, True)
    return StreamReport(reports, False)
