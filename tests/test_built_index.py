import math

import pytest
from pyspark.sql import functions as F

from momentlake.operators import anomalies, search, semantic
from momentlake.plans import artifacts, ingest

RECORD = "id string, artifact_id string, media_id string, start_ms long, end_ms long, json string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD).withColumn("data", F.parse_json("json")).drop("json")


def test_search_of_an_index_that_was_built(spark, tmp_path):
    rows = records(spark, [("record_b", "a1", "m", -5, 10, '{"t": "red car", "k": 1}'), ("record_a", "a1", "m", -5, 10, '{"t": "red car", "k": 2}'), ("record_c", "a1", "m", 7, 9, '{"t": "blue", "k": 3}')])
    known = spark.createDataFrame([("a1", "scene", "completed")], "id string, artifact_type string, status string")
    definition = artifacts.IndexDefinition("i", "scene", semantic_fields=("t",), filter_fields=("k",))
    built = artifacts.publish_index(rows, definition, 1, ingest.hashing_embedder(16), 16, f"{tmp_path}/index", known)
    version = semantic.IndexVersion("v", "p", "m", 16, fields=frozenset({"k"}))
    index, vectors = (x.withColumnRenamed("artifact_record_id", "record_id") for x in (built.index, built.embeddings))
    asked = spark.createDataFrame([(1, [float(x) for x in ingest.hashing_embedder(16)(["t: red car"])[0]])], "query_id long, embedding array<double>")
    hits = semantic.semantic_search(version, index, vectors, asked, 2, "p", "m")
    both = {r.artifact_record_id for r in built.index.filter("start_ms = -5").collect()}
    assert [r.record_id for r in hits.orderBy("rank").collect()] == sorted(both) and {r.start_ms for r in hits.collect()} == {-5}
    one = semantic.semantic_search(version, index, vectors, asked, 5, "p", "m", (("k", "gte", 2),))
    assert one.count() == 2


def test_large_numeric_ids_and_negative_starts_keep_their_order(spark):
    base = 1 << 60
    rows = spark.createDataFrame([(base + 1, -2000), (base, -2000), (base + 2, -10_000), (base + 3, 5)], "record_id long, start_ms long").withColumn("data", F.parse_json(F.lit("{}")))
    vectors = rows.select("record_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    hits = semantic.semantic_search(semantic.IndexVersion("v", "p", "m", 2), rows, vectors, asked, 4, "p", "m").orderBy("rank").collect()
    assert [r.record_id - base for r in hits] == [2, 0, 1, 3]


def test_what_is_not_indexed(spark, tmp_path):
    embedder = ingest.hashing_embedder(4)
    definition = artifacts.IndexDefinition("i", "scene", semantic_fields=("t", "u"))
    blank = records(spark, [("r1", "a1", "m", 0, 1, '{"t": "x", "u": "y"}'), ("r2", "a1", "m", 0, 1, '{"t": " \\n", "u": ""}')])
    with pytest.raises(Exception, match="no text for the record r2"):
        artifacts.publish_index(blank, definition, 1, embedder, 4, f"{tmp_path}/1")
    with pytest.raises(ValueError, match="empty artifact"):
        artifacts.publish_index(blank.limit(0), definition, 1, embedder, 4, f"{tmp_path}/2")
    for kind, status in (("other", "completed"), ("scene", "failed")):
        known = spark.createDataFrame([("a1", kind, status)], "id string, artifact_type string, status string")
        with pytest.raises(ValueError, match="needs completed artifacts"):
            artifacts.publish_index(blank.filter("id = 'r1'"), definition, 1, embedder, 4, f"{tmp_path}/3", known)
    with pytest.raises(ValueError, match="needs completed artifacts"):
        artifacts.check_artifacts(blank, definition, known.limit(0))


def test_baseline_without_numbers(spark):
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(9)] + [(20, [float("nan"), 1.0]), (21, None), (22, [1.0]), (23, [float("inf"), 0.0]), (24, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    kept = {r.id for r in anomalies.exclude_baseline(df, 2).collect()}
    assert len(kept) == 5 and kept < set(range(9))
    huge = spark.createDataFrame([(i, [1e308, 1e308]) for i in range(5)], "id long, embedding array<double>")
    assert anomalies.exclude_baseline(huge, 2).count() >= 0
    assert anomalies.exclude_baseline(df.filter("id > 19"), 2).count() == 0


def test_top_k_by_group(spark):
    rows = [(i, "xyz"[i % 3] if i % 7 else None, [math.cos(i), math.sin(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [math.cos(q), math.sin(q)]) for q in (100, 101)], "query_id long, embedding array<double>")
    got = search.top_k(df, asked, 3, columns=("id",), ties=("id",), by="kind").collect()
    for q in (100, 101):
        for kind in ("x", "y", "z", None):
            best = sorted((round(-math.cos(i - q), 9), i) for i, k, _ in rows if k == kind)[:3]
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if (r.query_id, r.kind) == (q, kind)] == [i for _, i in best]
