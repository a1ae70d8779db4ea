"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentlake.llm._shared import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (or its smaller ones and itself) to the least of them all.

    A node's edges are dealt over as many tasks as there are shuffle partitions; one row for each is gathered for its least neighbour.
    """
    if large:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)))
    least = both.groupBy("a", "part").agg(F.min("b").alias("m")).select("a", "part", F.least(F.min("m").over(W.partitionBy("a")), "a").alias("m"))
    linked = both.join(least, ["a", "part"])
    if large:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ends = F.explode(F.array(F.col("a"), F.col("b"))).alias("a")
    return linked.select(ends, F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) of all nodes in edges (a, b: long)."""
    edges, last = edges.filter("a <> b"), None
    while True:
        seen = Observation()
        step = _star(_star(edges, large=True), large=False)
        edges = stage(step.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        now = (seen.get["n"], seen.get["h"])
        if now == last or not now[0]:
            break
        last = now
    each = edges.select(F.explode(F.array(F.greatest("a", "b"), F.least("a", "b"))).alias("node"), F.least("a", "b").alias("component"))
    return each.groupBy("node").agg(F.min("component").alias("component"))
