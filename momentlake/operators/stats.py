"""Statistics of stores by mergeable sketches: a row for each snapshot, merged without a look at its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_BITS = 14
#: Of distinct counts by a sketch of so many bits: the relative standard error.
ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def snapshot_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, sources (a sketch) of chunks (source_file)."""
    return chunks.agg(F.count("*").alias("chunks"), F.hll_sketch_agg("source_file", F.lit(SKETCH_BITS)).alias("sources"))


def merged(stats: DataFrame) -> DataFrame:
    """chunks, sources (estimated) of all rows of snapshot_stats()."""
    return stats.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sources")), F.lit(0)).alias("sources"))


def sources(chunks: DataFrame) -> DataFrame:
    """source_file, chunks: the sources there are, in order, with their numbers of chunks."""
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunks")).orderBy("source_file")
