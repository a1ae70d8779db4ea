"""Nearest neighbours of all rows where all pairs are too many: random projections, with the recall they reach.

A table sorts the rows by the signs of some random projections and then by one more, and deals them to ranges of about
`block` rows; rows of a range are compared with each other, so that a table costs one shuffle of the rows and
rows x block products, however alike the rows are. Equal vectors are told apart by their ids and may fill many ranges.
Tables are added until the neighbours of a sample of rows, whose true ones one scan gives, are found with the recall asked for.
Where the neighbours have to be the true ones (complete), those of the first tables bound how far the true ones can be,
and one sweep over all pairs of blocks gives what is within those bounds: quadratic, but without sorting what is far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.functions import vectors
from momentlake.operators.anomalies import lof_of, mean_distances, neighbours
from momentlake.operators.search import CELLS, largest, rank_within, top_k
from momentlake.sources.shared import shared_path

EXACT_ROWS, BLOCK, SAMPLE, SIGNS = 50_000, 4096, 256, 6


def _table(rows: DataFrame, dimension: int, centre: np.ndarray, number: int, blocks: int, k: int) -> DataFrame:
    """a, b, distance: each row's k nearest in its range of one table."""
    directions = np.random.default_rng(number).normal(size=(SIGNS + 1, dimension))
    offsets = directions @ centre

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b["embedding"].flatten(), np.float64).reshape(b.num_rows, -1)
            p = x @ directions.T - offsets
            signs = (p[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS)[::-1])
            signs = signs ^ (signs >> 1)  # so that neighbouring numbers differ in one sign mostly
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signs, pa.int64()), pa.array(p[:, SIGNS])], ["id", "embedding", "signs", "place"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("id")
        ids, x = t["id"].to_numpy(), np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        step = max(1, CELLS // len(ids))
        for at in range(0, len(ids), step):
            near = x[at : at + step] @ x.T - 1
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
            i, j, v, _ = largest(near, k)
            keep = np.isfinite(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + i[keep]]), pa.array(ids[j[keep]]), pa.array(0.0 - v[keep])], ["a", "b", "distance"])

    dealt = rows.mapInArrow(placed, "id long, embedding array<double>, signs long, place double").repartitionByRange(blocks, "signs", "place", "id")
    return dealt.select("id", "embedding").mapInArrow(nearest, "a long, b long, distance double")


def approximate_neighbours(df: DataFrame, k: int, recall: float = 0.9, block: int = BLOCK, most_tables: int = 64, at_once: int = 4, sample: int = SAMPLE, complete: bool = False) -> DataFrame:
    """a, b, distance, rank, recall: k near others of each row (id long, unique; unit-length embedding), ties to smaller ids.

    recall: the share of the sample's true neighbours, or others as near, that was found; tables are added, at_once at
    a time, until it reaches the one asked for or there are most_tables. complete: after the first tables a sweep
    finds whatever they missed. Vectors that are null or hold null or non-finite components take no part.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "near")

    def staged(x: DataFrame, name: str) -> DataFrame:
        x.write.parquet(f"{path}/{name}")
        return spark.read.schema(x.schema).parquet(f"{path}/{name}")

    rows = staged(df.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter(vectors.is_valid(F.col("embedding"))), "rows")
    n, dimension = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    empty = spark.createDataFrame([], "a long, b long, distance double, rank int, recall double")
    if n < 2:
        return empty
    some = staged(rows.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    centre = np.median(np.asarray(some.select("embedding").toArrow()["embedding"].combine_chunks().flatten()).reshape(-1, dimension), axis=0)
    asked = some.select(F.col("id").alias("query_id"), "embedding")
    own = min(k, n - 1)
    true = top_k(rows, asked, own + 1, dimension, columns=("id",), ties=("id",)).filter("query_id <> id")
    true = staged(rank_within(true, own, ["query_id"], [F.desc("score"), F.col("id")], "place").filter(F.col("place") == own).select(F.col("query_id").alias("a"), F.col("distance").alias("kth")), "true")
    blocks, best, tables, reached = -(-n // block), None, 0, 0.0
    while reached < recall and tables < (at_once if complete else most_tables):
        found = best.drop("rank") if best is not None else None
        for number in range(tables, tables + at_once):
            table = _table(rows, dimension, centre, number, blocks, k)
            found = table if found is None else found.unionByName(table)
        tables += at_once
        best = staged(rank_within(found.groupBy("a", "b").agg(F.min("distance").alias("distance")), k, ["a"], [F.col("distance"), F.col("b")]), f"best{tables}")
        if complete and blocks > 1:
            kth = best.filter(F.col("rank") == own).select(F.col("a").alias("id"), F.col("distance").alias("bound"))
            best = staged(neighbours(rows, own, kth), "complete")
        hit = best.join(true, "a").filter(F.col("distance") <= F.col("kth") + 1e-9).count()
        reached = hit / max(1, true.count() * own)
    return best.withColumn("recall", F.lit(float(min(reached, 1.0))))


def any_neighbours(df: DataFrame, k: int, exact_rows: int = EXACT_ROWS, **more: object) -> DataFrame:
    """a, b, distance, rank, mode, recall: exact neighbours of up to exact_rows rows, approximate ones of more."""
    if df.limit(exact_rows + 1).count() <= exact_rows:
        return neighbours(df, k).withColumns({"mode": F.lit("exact"), "recall": F.lit(1.0)})
    return approximate_neighbours(df, k, **more).withColumn("mode", F.lit("approximate"))


def knn_scores(df: DataFrame, k: int, exact_rows: int = EXACT_ROWS, **more: object) -> DataFrame:
    """id, score, mode, recall: anomalies.knn_scores() by any_neighbours()."""
    near = any_neighbours(df, max(1, k), exact_rows, **more)
    return mean_distances(near, "mode", "recall")


def lof_scores(df: DataFrame, k: int, exact_rows: int = EXACT_ROWS, **more: object) -> DataFrame:
    """id, score, mode, recall: anomalies.lof_scores() by any_neighbours(), for three rows or more."""
    near = any_neighbours(df, max(2, k), exact_rows, **more)
    path = shared_path(df.sparkSession, "neighbours")
    near.write.parquet(path)
    near = df.sparkSession.read.schema(near.schema).parquet(path)
    said = near.select("mode", "recall").limit(1)
    return lof_of(near).join(F.broadcast(said))
