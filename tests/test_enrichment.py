import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.operators import records, stats
from momentlake.plans import enrichment, ingest
from momentlake.sources.snapshots import SnapshotTable


def rows(spark, some):
    df = spark.createDataFrame(some, "id string, modality string, start_time double, json string")
    return df.select("id", F.lit("/a").alias("source_file"), "modality", "start_time", (F.col("start_time") + 1).alias("end_time"), F.parse_json("json").alias("data"))


def test_each_record_once(spark, tmp_path):
    store = SnapshotTable(spark, f"{tmp_path}/store", spark.createDataFrame([], enrichment.SEGMENT).schema)
    some = [("a", "ocr", 0.0, '{"text": "red"}'), ("b", "ocr", 0.0, '{"text": " \\n"}'), ("c", "other", 0.0, '{"text": "x"}'), ("a", "ocr", 5.0, '{"text": "later"}')]
    embedder = ingest.hashing_embedder(4)
    got = enrichment.enrich(rows(spark, some), store, embedder, 4, "p", "m")
    assert (got.seen, got.indexed, got.empty) == (4, 1, 2)
    got = enrichment.enrich(rows(spark, [*some, ("d", "transcript", 1.0, '{"text": "new"}')]), store, embedder, 4, "p", "m")
    assert (got.seen, got.indexed, got.empty) == (5, 1, 2)
    assert sorted((r.id, r.text, len(r.embedding)) for r in store.read().collect()) == [("a", "red", 4), ("d", "new", 4)]
    with pytest.raises(Exception, match="no valid vector of the record e"):
        enrichment.enrich(rows(spark, [("e", "ocr", 0.0, '{"text": "x"}')]), store, lambda v: np.zeros((len(v), 3)), 4, "p", "m")
    assert store.read().count() == 2
    none = enrichment.enrich(rows(spark, some).limit(0), store, embedder, 4, "p", "m")
    assert (none.seen, none.indexed, none.empty) == (0, 0, 0)


def test_sketches_merge(spark):
    df = spark.range(9000).select((F.col("id") % 6000).cast("string").alias("source_file"))
    parts = stats.snapshot_stats(df.limit(5000)).unionByName(stats.snapshot_stats(df)).unionByName(stats.snapshot_stats(df.limit(0)))
    got = stats.merged(parts).first()
    assert got.chunks == 14_000 and abs(got.sources - 6000) <= 3 * stats.ERROR * 6000
    assert stats.merged(parts.limit(0)).first()[:] == (0, 0)


def test_lineage_with_circles_and_many_categories(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 3), (8, 9)], "parent_id int, child_id int")
    roots = spark.createDataFrame([(1,), (8,), (7,)], "id int")
    assert sorted(tuple(r) for r in records.lineage(edges, roots).collect()) == [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 2), (8, 9, 1)]
    assert records.lineage(edges, roots, 0).count() == 0
    chunks = spark.createDataFrame([("f", 3.2), ("f", 7.1), ("g", 0.4)], "source_file string, x double")
    named = spark.range(9).select(F.col("id").alias("position"), F.concat(F.lit("c"), "id").alias("name"), F.col("id").cast("double").alias("centre"))
    for group in (2, 100):
        best = records.best_category(chunks, named, -F.abs(F.col("x") - F.col("centre")), group).collect()
        assert {r.source_file: r.category for r in best} == {"f": "c7", "g": "c0"}
