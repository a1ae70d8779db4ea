"""Fusion of ranked lists: weighted reciprocal ranks, with merging of moments that overlap in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.functions.moments import overlap_ratio
from momentlake.functions.text import evidence
from momentlake.operators.search import rank_within

# Weight of each list, in the order in which the lists are merged.
WEIGHTS = {"visual": 0.40, "scene_caption": 0.25, "ocr": 0.15, "transcript": 0.20, "exact": 0.75}
RANK_BASE, LEAST_OVERLAP = 60, 0.20


def depth(n: int) -> int:
    """How many candidates each list gives for n results."""
    return min(max(8 * n, 24), 400)


def reciprocal_rank(lists: DataFrame, n: int) -> DataFrame:
    """Plain fusion by id: query_id, rank, id, score of lists (query_id, list, rank, id)."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    scored = lists.withColumn("rrf", weight[F.col("list")] / (RANK_BASE + F.col("rank")))
    fused = scored.groupBy("query_id", "id").agg(F.sum("rrf").alias("rrf"))
    best = rank_within(fused, n, ["query_id"], [F.desc(F.round("rrf", 12)), F.col("id")])
    return best.withColumn("score", F.least(F.col("rrf") * (RANK_BASE + 1), F.lit(1.0))).drop("rrf")


def fuse(lists: DataFrame, n: int) -> DataFrame:
    """query_id, rank, source_file, start_time, end_time, score, primary_modality, evidence, score_breakdown of ranked lists.

    lists: query_id, list (a key of WEIGHTS), rank, source_file, start_time, end_time, score, modality, text.
    Hits are taken in the order of lists, then ranks. A hit that overlaps a candidate of its source by a
    fifth of the shorter span joins the first such candidate, whose span grows; visual hits never merge.
    Spans of one source and query are bounded by the lists' depth, and are folded as one array.
    """
    order = F.create_map(*(F.lit(x) for i, k in enumerate(WEIGHTS) for x in (k, i)))
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    exact, visual = F.col("list") == "exact", F.col("list") == "visual"
    named = F.when(exact, F.lit("exact")).otherwise(F.col("list"))
    hit = F.struct(
        order[F.col("list")].alias("o"),
        "rank",
        F.col("start_time").cast("double").alias("a"),
        F.col("end_time").cast("double").alias("b"),
        (weight[F.col("list")] / (RANK_BASE + F.col("rank"))).alias("rrf"),
        F.when(exact, 1.0).otherwise(weight[F.col("list")] * F.col("score")).alias("priority"),
        F.when(visual, "visual").otherwise(F.col("modality")).alias("modality"),
        F.when(visual | (F.trim("text") == "") | F.col("text").isNull(), None).otherwise(evidence(F.col("text"))).alias("evidence"),
        F.when(visual, 0.0).when(exact, 2.0).otherwise(F.greatest("score", F.lit(0.0))).alias("evidence_priority"),
        named.alias("name"),
        F.col("score").cast("double").alias("score"),
    )
    groups = lists.groupBy("query_id", "source_file").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    kind = (
        "array<struct<o: int, rank: int, ga: double, gb: double, a: double, b: double, rrf: double, priority: double, "
        "modality: string, evidence: string, evidence_priority: double, scores: map<string, double>>>"
    )

    def opened(h):  # noqa: ANN001, ANN202
        return F.struct(h["o"].cast("int").alias("o"), h["rank"].cast("int").alias("rank"), h["a"].alias("ga"), h["b"].alias("gb"), h["a"].alias("a"), h["b"].alias("b"), h["rrf"].alias("rrf"), h["priority"].alias("priority"), h["modality"].alias("modality"), h["evidence"].alias("evidence"), h["evidence_priority"].alias("evidence_priority"), F.create_map(h["name"], h["score"]).alias("scores"))

    def merged(c, h):  # noqa: ANN001, ANN202
        first, told = h["priority"] > c["priority"], (h["evidence_priority"] > c["evidence_priority"]) & h["evidence"].isNotNull()
        scores = F.map_zip_with(c["scores"], F.create_map(h["name"], h["score"]), lambda _, x, y: F.greatest(x, y))
        return F.struct(
            c["o"].alias("o"), c["rank"].alias("rank"), F.least(c["ga"], h["a"]).alias("ga"), F.greatest(c["gb"], h["b"]).alias("gb"),
            F.when(first, h["a"]).otherwise(c["a"]).alias("a"), F.when(first, h["b"]).otherwise(c["b"]).alias("b"), (c["rrf"] + h["rrf"]).alias("rrf"),
            F.greatest(c["priority"], h["priority"]).alias("priority"), F.when(first, h["modality"]).otherwise(c["modality"]).alias("modality"),
            F.when(told, h["evidence"]).otherwise(c["evidence"]).alias("evidence"), F.when(told, h["evidence_priority"]).otherwise(c["evidence_priority"]).alias("evidence_priority"), scores.alias("scores"),
        )

    def add(found, h):  # noqa: ANN001, ANN202
        near = F.transform(found, lambda c: (h["o"] > 0) & (overlap_ratio(c["ga"], c["gb"], h["a"], h["b"]) >= LEAST_OVERLAP))
        at = F.array_position(near, True)
        return F.when(at == 0, F.concat(found, F.array(opened(h)))).otherwise(F.transform(found, lambda c, i: F.when(i + 1 == at, merged(c, h)).otherwise(c)))

    each = groups.select("query_id", "source_file", F.inline(F.aggregate("hits", F.array().cast(kind), lambda s, h: add(s, h).cast(kind))))
    best = rank_within(each.withColumnRenamed("rank", "seq"), n, ["query_id"], [F.desc("rrf"), F.col("o"), F.col("seq"), F.col("source_file"), F.col("a")])
    score = F.least(F.greatest(F.col("rrf") * (RANK_BASE + 1), F.lit(0.0)), F.lit(1.0))
    return best.select("query_id", "rank", "source_file", F.col("a").alias("start_time"), F.col("b").alias("end_time"), score.alias("score"), F.col("modality").alias("primary_modality"), "evidence", F.col("scores").alias("score_breakdown"))
