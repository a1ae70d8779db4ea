"""Records of artifacts as searchable texts with vectors, each record once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from momentlake.functions.text import searchable_text
from momentlake.functions.vectors import is_valid
from momentlake.plans.artifacts import staged
from momentlake.plans.ingest import Embedder, embed_wanted
from momentlake.sources.snapshots import SnapshotTable

SEGMENT = "id string, source_file string, modality string, start_time double, end_time double, text string, backend string, model string, embedding array<double>"


@dataclass(frozen=True)
class EnrichmentReport:
    seen: int
    indexed: int
    empty: int


def enrich(records: DataFrame, store: SnapshotTable, embedder: Embedder, dimension: int, backend: str, model: str) -> EnrichmentReport:
    """Adds records (id, source_file, modality, start_time, end_time, data) that the store does not have, with their texts and vectors.

    seen: all records; indexed: those that are added; empty: those that are not stored and have no text. Of records
    with one id, the one of the earliest start (then modality) counts. A text without a valid vector is an error, and
    nothing is added then.
    """
    first = F.min(F.struct("start_time", "modality", "source_file", "end_time", F.trim(F.coalesce(searchable_text(F.col("modality"), F.col("data")), F.lit(""))).alias("text")))
    rows = records.groupBy("id").agg(first.alias("r"), F.count("*").alias("times")).select("id", "r.*", "times")
    rows = rows.join(store.read().select("id", F.lit(True).alias("stored")), "id", "left")
    blank = ~F.col("text").rlike(r"(?U)\S")
    status = F.when(F.col("stored").isNotNull(), "stored").when(blank, "empty").otherwise("new")
    done = embed_wanted(rows.withColumn("status", status).drop("stored"), "text", F.col("status") == "new", embedder, attempts=1)
    wrong = F.raise_error(F.concat(F.lit("no valid vector of the record "), "id", F.lit(": "), F.coalesce("error", F.lit("wrong dimension")))).cast("array<double>")
    vector = F.when(F.col("status") != "new", F.lit(None)).when(is_valid(F.col("vector"), dimension), F.col("vector")).otherwise(wrong)
    seen = Observation("enrichment")
    out = done.select("id", "source_file", "modality", "start_time", "end_time", "text", "times", "status", F.lit(backend).alias("backend"), F.lit(model).alias("model"), vector.alias("embedding"))
    counts = F.coalesce(F.sum("times"), F.lit(0)).alias("seen"), F.count_if(F.col("status") == "new").alias("indexed"), F.coalesce(F.sum(F.when(F.col("status") == "empty", F.col("times"))), F.lit(0)).alias("empty")
    new = staged(out.observe(seen, *counts), "enriched").filter("status = 'new'").drop("status", "times")
    report = EnrichmentReport(**seen.get)
    if report.indexed:
        store.overwrite(store.read().unionByName(new.select(*store.schema.names)))
    return report
