"""Analyzer manifests: JSON arrays of outputs with nested records, as the rows that an import takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name string, analyzer_type string, model_provider string, model_name string, model_revision string, config string, artifact_type string, "
    "schema_version long, schema_definition string, records array<struct<segment_id: string, start_ms: bigint, end_ms: bigint, data: string, metadata: string>>"
)


def read_manifests(spark: SparkSession, path: str, media_id: str, key: str) -> DataFrame:
    """media_id, key, name, artifact_type, schema_version, segment_id, start_ms, end_ms, data, metadata of the records in the files under path."""
    each = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select("name", "artifact_type", "schema_version", F.explode("records").alias("r"))
    return each.select(
        F.lit(media_id).alias("media_id"),
        F.lit(key).alias("key"),
        "name",
        "artifact_type",
        "schema_version",
        "r.segment_id",
        "r.start_ms",
        "r.end_ms",
        F.try_parse_json("r.data").alias("data"),
        F.try_parse_json("r.metadata").alias("metadata"),
    )
