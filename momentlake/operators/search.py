"""Vector search for a table of queries: exact top-k, source scoping, near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentlake.functions import vectors
from momentlake.sources.shared import shared_path

DIGITS = 9
GROUP_BYTES, CELLS = 32 << 20, 1 << 21  # of a group of queries; scores computed at a time


def rank_within(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; partial top-k runs before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def in_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of the given sources (source_file): an empty set gives an empty table, before anything is scored."""
    return chunks.join(sources.select("source_file").distinct(), "source_file", "left_semi")


def unit_rows(df: DataFrame) -> DataFrame:
    """df with embedding at unit length, so that dot products are cosines; a zero vector stays zero."""
    return df.withColumn("embedding", vectors.l2_normalize(F.col("embedding")))


MOMENT, TIES = ("id", "source_file", "start_time", "end_time"), ("source_file", "start_time", "id")


def top_k(chunks: DataFrame, queries: DataFrame, k: int, dimension: int | None = None, group_rows: int | None = None, columns: tuple[str, ...] = MOMENT, ties: tuple[str, ...] = TIES, by: str | None = None) -> DataFrame:
    """query_id, rank, columns, score, distance: the k best of unit-length chunks by dot product; with by, of each value of that column.

    Queries go to the tasks in groups of group_rows, or of about GROUP_BYTES; each group scans the chunks once, and where
    there are several, its hits are written before the next one starts, so that one group is held at a time. In a
    task, a batch of chunks gives the hits that are among the k best of all its batches so far. Ties go by the columns
    of ties, which are among columns. Null vectors and such with null or non-finite components take no part; one of
    another dimension than the queries' is an error.
    """
    spark, kept = chunks.sparkSession, list(dict.fromkeys([*columns, *([by] if by else [])]))
    rows = chunks.select(*kept, F.col("embedding").cast("array<double>").alias("embedding"))
    hit = "query_id long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", score double"
    n, size = queries.agg(F.count("*"), F.max(F.size("embedding"))).first() if k > 0 else (0, 0)
    if not n:
        return spark.createDataFrame([], hit + ", rank int, distance double")
    dimension = dimension or size or 0
    groups = -(-n // (group_rows or max(1024, GROUP_BYTES // (8 * max(dimension, 1)))))
    queries = queries.filter(_right(F.col("embedding"), dimension))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("query"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g"))
    rows = rows.filter(_right(F.col("embedding"), dimension))
    best, path = None, shared_path(spark, "hits")
    for g in range(groups):
        found = _scored(rows, asked.filter(F.col("g") == g), k, hit, ties, by)
        best = rank_within(found, k, ["query_id", *([by] if by else [])], [F.desc("score"), *map(F.col, ties)])
        if groups > 1:
            best.write.mode("append").parquet(path)
    if groups > 1:
        best = spark.read.parquet(path)
    return best.withColumn("distance", 1 - F.col("score"))


def _right(v: Column, dimension: int) -> Column:
    """Whether a vector takes part; one of another dimension is an error."""
    other = F.raise_error(F.concat(F.lit(f"a vector has not {dimension} dimensions but "), F.size(v).cast("string"))).cast("boolean")
    return F.when(vectors.is_valid(v) & (F.size(v) != dimension), other).otherwise(vectors.is_valid(v))


def largest(s: np.ndarray, k: int, least: np.ndarray | None = None, few: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, value and place of each row's k largest values (of those that reach its least), ties to smaller columns; few: where few reach it, so that values need not be parted first."""
    n = s.shape[1]
    limit = least
    if not few:
        limit = np.partition(s, n - min(k, n), axis=1)[:, n - min(k, n)]
        limit = limit if least is None else np.maximum(limit, least)
    i, j = np.nonzero(s >= limit[:, None])
    v = s[i, j]
    order = np.lexsort((j, -v, i))
    i, j, v = i[order], j[order], v[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], j[keep], v[keep], place[keep]


def _scored(rows: DataFrame, asked: DataFrame, k: int, hit: str, ties: tuple[str, ...], by: str | None) -> DataFrame:
    """Hits of one bounded group of queries, which goes to all tasks; each query's k best of a task (for each value of by) are among them."""
    group = asked.toArrow()
    matrix = np.asarray(group["query"].combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)
    held = rows.sparkSession.sparkContext.broadcast((group["query_id"].to_numpy(), matrix))  # GROUP_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        best: dict[object, np.ndarray] = {}  # the best scores so far
        for whole in batches:
            if not whole.num_rows or not len(ids):
                continue
            for value in pc.unique(whole[by]).to_pylist() if by else [None]:
                b = whole if not by else whole.filter(pc.is_null(whole[by]) if value is None else pc.equal(whole[by], value))
                b = b.take(pc.sort_indices(b, [(c, "ascending") for c in ties]))
                kept = best.setdefault(value, np.full((len(ids), k), -np.inf))
                x = np.asarray(b["embedding"].flatten(), np.float64).reshape(b.num_rows, -1)
                step = max(1, CELLS // b.num_rows)
                for at in range(0, len(ids), step):
                    s = (matrix[at : at + step] @ x.T).round(DIGITS)  # so that equal vectors tie, however the product is summed
                    i, j, v, place = largest(s, k, kept[at : at + step, -1])
                    if not len(i):
                        continue
                    top = np.full((len(s), k), -np.inf)
                    top[i, place] = v
                    kept[at : at + step] = -np.sort(-np.hstack([kept[at : at + step], top]), axis=1)[:, :k]
                    hits = b.drop_columns(["embedding"]).take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), *hits.columns, pa.array(v)], ["query_id", *hits.schema.names, "score"])

    return rows.mapInArrow(score, hit)


def dedupe_ranked(hits: DataFrame, threshold: float, limit: int | None = None) -> DataFrame:
    """Walks each query's ranked hits (query_id, rank, embedding, ...) and keeps those at most threshold similar to all kept ones.

    A hit list is bounded by its k; it is folded as one array, without Python.
    """
    others = [c for c in hits.columns if c != "query_id"]
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in others if c != "rank")))).alias("hits"))
    empty = F.slice("hits", 1, 0)

    def keep(kept: Column, hit: Column) -> Column:
        near = F.exists(kept, lambda x: vectors.cosine(x["embedding"], hit["embedding"]) > threshold)
        full = F.lit(False) if limit is None else F.size(kept) >= limit
        return F.when(near | full, kept).otherwise(F.concat(kept, F.array(hit)))

    return lists.select("query_id", F.inline(F.aggregate("hits", empty, keep)))
