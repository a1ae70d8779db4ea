"""Anomaly ranking of unit vectors: centroid, k nearest neighbours, local outlier factor, and highlight selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentlake.functions import vectors
from momentlake.operators.search import CELLS, dedupe_ranked, largest, rank_within
from momentlake.sources.shared import shared_path

BLOCK, BLOCK_BYTES, FRAME_BYTES = 2048, 32 << 20, 4 << 20
SLACK = 1e-9  # what sums of products may differ by between two orders
STILL_SPREAD = 0.03  # fixed value: how far the brightness of a still span may vary


def centroid(df: DataFrame, dimension: int) -> DataFrame:
    """One row: the normalized mean of embedding."""
    return df.agg(vectors.component_mean(F.col("embedding"), dimension).alias("m")).select(vectors.l2_normalize(F.col("m")).alias("centroid"))


def centroid_scores(df: DataFrame, dimension: int) -> DataFrame:
    """score = 1 - dot(embedding, centroid)."""
    return df.join(F.broadcast(centroid(df, dimension))).withColumn("score", 1 - vectors.dot(F.col("embedding"), F.col("centroid"))).drop("centroid")


def _nth(df: DataFrame, column: str, n: int, most: int = 10_000) -> float:
    """The value at place n (from 0) of a column of doubles in ascending order: counts in ranges narrow it down until at most `most` rows are left."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    rows = df.select(F.col(column).alias("x"))
    while True:
        if not low < high:
            return low
        inside = rows.filter((F.col("x") >= low) & (F.col("x") <= high))
        place = F.least(F.floor((F.col("x") - low) / (high - low) * 1024), F.lit(1023)).alias("place")
        for r in inside.groupBy(place).agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("place").collect():  # 1,024 at most
            if n < r.rows:
                break
            n -= r.rows
        if r.rows <= most:
            return inside.filter((F.col("x") >= r.low) & (F.col("x") <= r.high)).orderBy("x").offset(n).limit(1).first().x
        low, high = r.low, r.high


def exclude_baseline(df: DataFrame, dimension: int) -> DataFrame:
    """Keeps rows at least as far from the centroid as the upper median row; all rows if there are under four.

    Vectors that are null, of another dimension or hold null or non-finite components take no part and are left out.
    """
    df = df.filter(vectors.is_valid(F.col("embedding"), dimension))
    scored = centroid_scores(df, dimension)
    finite = scored.filter(F.abs("score") < float("inf"))  # sums of huge components may overflow; NaN is no number here either
    n = finite.count()
    if n < 4:
        return df
    cutoff = _nth(finite, "score", n // 2)
    return scored.filter(F.col("score") >= cutoff).drop("score")


def neighbours(df: DataFrame, k: int, bounds: DataFrame | None = None) -> DataFrame:
    """a, b, distance, rank: each row's k nearest others by cosine distance (id long, embedding), ties to smaller ids.

    Rows are cut into n blocks, and each pair of blocks is compared in a task, of which each row's k best leave it:
    2 * n copies of a row are shuffled. Blocks hold BLOCK rows, more (up to BLOCK_BYTES) once there are pairs enough
    for all cores. Vectors that are null or hold null or non-finite components take no part. bounds: id, bound of rows
    whose k-th neighbour is known to be no farther than that; their block pairs then give what is within it only.
    """
    rows = df.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter(vectors.is_valid(F.col("embedding")))
    rows = rows.withColumn("bound", F.lit(float("inf"))) if bounds is None else rows.join(bounds.select("id", "bound"), "id", "left").fillna(float("inf"), "bound")
    count, size = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    enough = math.ceil(math.sqrt(4 * df.sparkSession.sparkContext.defaultParallelism))
    n = max(1, -(-count * 8 * (size or 1) // BLOCK_BYTES), min(-(-count // BLOCK), enough))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            x, y = (np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (left, right))
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            least = -left["bound"].to_numpy() - SLACK
            step = max(1, CELLS // len(b))
            for at in range(0, len(a), step):
                near = x[at : at + step] @ y.T - 1
                near[a[at : at + step, None] == b[None, :]] = -np.inf
                own = least[at : at + step]
                i, j, v, _ = largest(near, k, own, bool(np.isfinite(own).all()))
                keep = np.isfinite(v)
                parts.append((a[at + i[keep]], b[j[keep]], 0.0 - v[keep]))
        return pa.table(dict(zip(("a", "b", "distance"), (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)))

    one = rows.withColumn("j", other).groupBy("i", "j")
    two = rows.select(F.col("id").alias("id"), F.col("embedding").alias("embedding"), F.col("i").alias("j")).withColumn("i", other).groupBy("i", "j")
    pairs = one.cogroup(two).applyInArrow(nearest, "a long, b long, distance double")
    return rank_within(pairs, k, ["a"], [F.col("distance"), F.col("b")])


def knn_scores(df: DataFrame, k: int) -> DataFrame:
    """id, score: the mean distance to the k nearest others, k within 1 and n - 1."""
    return mean_distances(neighbours(df, max(1, k)))


def mean_distances(near: DataFrame, *same: str) -> DataFrame:
    """id, score and the columns that are the same in all rows, of neighbours (a, b, distance)."""
    return near.groupBy(F.col("a").alias("id")).agg(F.avg("distance").alias("score"), *(F.first(c).alias(c) for c in same))


def lof_scores(df: DataFrame, k: int) -> DataFrame:
    """id, score: local outlier factor with exactly k neighbours (2 to n - 1); 0 for every row if there are under three."""
    if df.count() < 3:
        return df.select("id", F.lit(0.0).alias("score"))
    path = shared_path(df.sparkSession, "neighbours")  # read three times, and kept if an executor is lost
    neighbours(df, max(2, k)).write.parquet(path)
    return lof_of(df.sparkSession.read.parquet(path))


def lof_of(near: DataFrame) -> DataFrame:
    """id, score: local outlier factors by neighbours (a, b, distance), which are read three times."""
    reach = near.groupBy(F.col("a").alias("b")).agg(F.max("distance").alias("k_distance"))
    density = near.join(reach, "b").groupBy("a").agg((1 / (F.avg(F.greatest("k_distance", "distance")) + 1e-12)).alias("lrd"))
    about = near.select("a", "b").join(density.select(F.col("a").alias("b"), F.col("lrd").alias("near_lrd")), "b").groupBy("a").agg(F.avg("near_lrd").alias("near_lrd"))
    return density.join(about, "a").select(F.col("a").alias("id"), (F.col("near_lrd") / (F.col("lrd") + 1e-12)).alias("score"))


def weight_by_query(df: DataFrame, query: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] by their range (at least 1e-12), times the similarity to the query, if positive."""
    bounds = df.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = (F.col("score") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    near = F.greatest(vectors.dot(F.col("embedding"), F.col("query")), F.lit(0.0))
    return df.join(F.broadcast(bounds)).join(F.broadcast(query.select(F.col("embedding").alias("query")).limit(1))).withColumn("score", scaled * near).drop("low", "high", "query")


def select_highlights(scored: DataFrame, count: int, threshold: float, block: int = 256) -> DataFrame:
    """The count best rows (id, embedding, score) of which no two are more than threshold alike, by score; rank among all rows.

    In rounds: rows like those chosen so far are filtered out where they are, and the best `block` of the rest (a bounded
    list) are walked in order. Each round but the last chooses one at least, so there are at most count of them.
    """
    spark, rest, chosen = scored.sparkSession, scored, []
    shape = scored.select("id", "embedding", "score").schema
    while len(chosen) < count:
        first = rest.select("id", "embedding", "score").orderBy(F.desc("score"), "id").limit(block)
        ranked = first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).withColumn("query_id", F.lit(0))
        found = dedupe_ranked(ranked, threshold, count - len(chosen)).drop("query_id").orderBy("rank").collect()  # count rows at most
        if not found:
            break
        chosen += [(r.id, r.embedding, r.score) for r in found]
        kept = F.broadcast(spark.createDataFrame([(r.embedding,) for r in found], "kept array<double>").agg(F.collect_list("kept").alias("kept")))
        alike = F.exists("kept", lambda x: vectors.cosine(x, F.col("embedding")) > threshold)
        rest = rest.join(kept).filter(~alike).drop("kept").filter((F.col("score") < found[-1].score) | ((F.col("score") == found[-1].score) & (F.col("id") > found[-1].id)))
    best = spark.createDataFrame(chosen, shape)
    above = scored.select(F.col("id").alias("o"), F.col("score").alias("s")).join(F.broadcast(best.select("id", "score")), (F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("o") <= F.col("id"))))
    ranks = above.groupBy("id").agg(F.count("*").cast("int").alias("rank"))
    return best.join(ranks, "id").select("rank", "id", "embedding", "score")


def span_luma(frames: DataFrame) -> DataFrame:
    """span_id, frame_idx, luma of frames (span_id, frame_idx, rgb): mean BT.601 luminance in [0, 1]."""

    def luma(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rgb, values = b["rgb"].fill_null(b""), np.zeros(b.num_rows)
            sizes = pc.binary_length(rgb).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes >= 3]):  # frames of one size are one array
                same, step = np.flatnonzero(sizes == size), max(1, FRAME_BYTES // int(size))
                for at in range(0, len(same), step):
                    some = same[at : at + step]
                    x = np.frombuffer(b"".join(rgb.take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), size)
                    values[some] = (x[:, : size // 3 * 3].reshape(len(some), -1, 3) @ np.array([0.299, 0.587, 0.114])).mean(1) / 255
            yield pa.RecordBatch.from_arrays([b["span_id"], b["frame_idx"], pa.array(values, pa.float64())], ["span_id", "frame_idx", "luma"])

    return frames.select("span_id", "frame_idx", "rgb").mapInArrow(luma, "span_id long, frame_idx int, luma double")


def still_spans(frames: DataFrame, spread: float = STILL_SPREAD) -> DataFrame:
    """span_id of spans with two frames or more, not all black, whose luminance varies by less than spread."""
    stats = span_luma(frames).groupBy("span_id").agg(F.count("*").alias("n"), F.max("luma").alias("high"), F.min("luma").alias("low"))
    return stats.filter((F.col("n") >= 2) & (F.col("high") > 0) & (F.col("high") - F.col("low") < spread)).select("span_id")
