"""Temporary SQL functions for sessions that work in SQL; their bodies are SQL, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"

FUNCTIONS = {
    "vector_dot": f"(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_DOT.format(a='a', b='b')}",
    "vector_norm": f"(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt({_DOT.format(a='a', b='a')})",
    "l2_normalize": "(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(a, x -> x / if(vector_norm(a) > 1e-12, vector_norm(a), 1D))",
    "cosine_similarity": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN if(vector_norm(a) > 1e-12 AND vector_norm(b) > 1e-12, vector_dot(a, b) / (vector_norm(a) * vector_norm(b)), 0D)",
    "segment_spans": """(duration_ms BIGINT, chunk_ms BIGINT, overlap_ms BIGINT) RETURNS ARRAY<STRUCT<i: BIGINT, start_ms: BIGINT, end_ms: BIGINT>>
        RETURN transform(sequence(0L, greatest(1L, CAST(ceil((duration_ms - overlap_ms) / (chunk_ms - overlap_ms)) AS BIGINT)) - 1),
                         i -> named_struct('i', i, 'start_ms', i * (chunk_ms - overlap_ms), 'end_ms', least(i * (chunk_ms - overlap_ms) + chunk_ms, duration_ms)))""",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
