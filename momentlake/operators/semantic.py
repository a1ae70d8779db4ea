"""Semantic search over index versions and over enrichment texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.functions.vectors import is_valid
from momentlake.operators import fusion, search, structured


@dataclass(frozen=True)
class IndexVersion:
    """What a search has to know of an index version; fields: those that filters may use."""

    id: str
    provider: str
    model: str
    dimension: int
    semantic: bool = True
    fields: frozenset[str] = frozenset()


def vector_from_field(data: Column, path: str, dimension: int) -> Column:
    """The array of finite numbers at a path of a record, as floats; an error if it is missing, not such an array or of another dimension."""
    v = F.try_variant_get(structured.field(data, path), "$", "array<double>").cast("array<float>")
    wrong = F.concat(F.lit(f"field {path!r} is no vector of {dimension} finite numbers: "), F.coalesce(F.to_json(structured.field(data, path)), F.lit("missing")))
    checked = lambda x: F.when(is_valid(x, dimension), x).otherwise(F.raise_error(wrong).cast("array<float>"))
    return F.transform(F.array(v), checked)[0]  # read once a record, not once for each check


def semantic_search(version: IndexVersion, records: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int, provider: str, model: str, filters: tuple[tuple[str, str, object], ...] = ()) -> DataFrame:
    """query_id, rank, record_id, start_ms, score: the k best records of an index version by cosine similarity.

    records: record_id (of any type that sorts), start_ms, data; embeddings: record_id, embedding, those without a record are left out.
    Filters apply to records before vectors are joined and scored. Ties go by start_ms and record_id.
    """
    if not version.semantic:
        raise ValueError(f"index {version.id} has no semantic projection")
    if (version.provider, version.model) != (provider, model):
        raise ValueError(f"index {version.id} uses {version.provider}/{version.model}, the query {provider}/{model}")
    used = {f[0] for f in filters}
    if used - version.fields:
        raise ValueError(f"fields not enabled on this index: {sorted(used - version.fields)}")
    for path, op, value in filters:
        records = records.filter(structured.predicate(F.col("data"), path, op, value))
    rows = records.select("record_id", "start_ms").join(embeddings.select("record_id", "embedding"), "record_id")
    hits = search.top_k(search.unit_rows(rows), search.unit_rows(queries), k, version.dimension, columns=("record_id", "start_ms"), ties=("start_ms", "record_id"))
    return hits.select("query_id", "rank", "record_id", "start_ms", "score")


def enrichment_search(segments: DataFrame, queries: DataFrame, k: int, backend: str, model: str, modalities: tuple[str, ...], sources: DataFrame | None = None) -> DataFrame:
    """query_id, list (the modality), rank, id, source_file, start_time, end_time, score: each modality's k best segments.

    segments: id, source_file, start_time, end_time, modality, backend, model, embedding; rows of another backend,
    model or dimension are skipped. Ties go by source_file, start_time and id.
    """
    rows = segments.filter((F.col("backend") == backend) & (F.col("model") == model))
    if sources is not None:
        rows = search.in_sources(rows, sources)
    dimension = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = rows.filter(is_valid(F.col("embedding"), dimension))
    rows = rows.filter(F.col("modality").isin(*modalities))
    hits = search.top_k(search.unit_rows(rows), search.unit_rows(queries), k, dimension, by="modality")  # one scan for all modalities
    return hits.withColumnRenamed("modality", "list")


def fused_or_visual(visual: DataFrame, lists: DataFrame, enriched: DataFrame, n: int) -> DataFrame:
    """Fused moments of the visual list and the others; the visual list's first n as they are while nothing is enriched.

    visual and lists: query_id, list, rank, source_file, start_time, end_time, score, modality, text; enriched: the stored texts.
    """
    if not enriched.isEmpty():
        return fusion.fuse(visual.unionByName(lists), n)
    plain = visual.filter(F.col("rank") <= n)
    return plain.select("query_id", "rank", "source_file", "start_time", "end_time", "score", F.lit("visual").alias("primary_modality"), F.lit(None).cast("string").alias("evidence"), F.create_map(F.lit("visual"), F.col("score")).alias("score_breakdown"))


def in_category(files: DataFrame, category: str | None) -> DataFrame:
    """Files of a category; all of them for None or "All"."""
    return files if category in (None, "All") else files.filter(F.col("category") == category)
