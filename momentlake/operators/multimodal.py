"""The whole search for moments: visual hits, three kinds of texts by meaning, and texts that hold the query's words, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.operators import fulltext, fusion, search, semantic

MODALITIES = ("scene_caption", "ocr", "transcript")
_LIST = ("query_id", "list", "rank", "source_file", "start_time", "end_time", "score", "modality", "text")


def search_moments(chunks: DataFrame, segments: DataFrame, queries: DataFrame, n: int, backend: str, model: str, sources: DataFrame | None = None, dedupe: float | None = None) -> DataFrame:
    """fusion.fuse()'s columns: for each query (query_id, text, embedding) its n best moments.

    chunks: id, source_file, start_time, end_time, embedding; segments: the same with modality, backend, model and text.
    Only sources that have chunks are searched, and only those asked for where sources (source_file) are given. Every
    list is cut to fusion.depth(n) candidates; dedupe: the similarity above which visual hits of a query are one. Without
    any segment the visual list is the result.
    """
    allowed = chunks.select("source_file").distinct()
    if sources is not None:
        allowed = allowed.join(sources.select("source_file").distinct(), "source_file", "left_semi")
    depth, own = fusion.depth(n), search.in_sources(chunks, allowed)
    visual = search.top_k(search.unit_rows(own), search.unit_rows(queries), depth)
    if dedupe is not None:
        vectors = own.select("id", "embedding")
        kept = search.dedupe_ranked(visual.join(vectors, "id"), dedupe).select(*visual.columns)
        visual = search.rank_within(kept.withColumnRenamed("rank", "place"), depth, ["query_id"], [F.col("place")])
    visual = visual.withColumns({"list": F.lit("visual"), "modality": F.lit("visual"), "text": F.lit("")})
    told = segments.select("id", "modality", "text")
    meant = semantic.enrichment_search(segments, queries, depth, backend, model, MODALITIES, allowed)
    meant = meant.join(told.withColumnRenamed("modality", "list"), ["id", "list"]).withColumn("modality", F.col("list"))
    held = fulltext.search(segments, queries.select("query_id", "text"), depth, allowed).join(segments.select("id", "source_file", "start_time", "end_time", "modality", "text"), "id").withColumn("list", F.lit("exact"))
    lists = [x.select(*_LIST) for x in (visual, meant, held)]
    return semantic.fused_or_visual(lists[0], lists[1].unionByName(lists[2]), segments, n)
