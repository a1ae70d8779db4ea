"""Edge cases of index versions, enrichment search, imports and snapshot tables."""

import pytest
from pyspark.sql import functions as F

from momentlake.functions import moments as M
from momentlake.functions import text as T
from momentlake.operators import records, search, semantic
from momentlake.plans import artifacts, ingest
from momentlake.sources import media
from momentlake.sources.snapshots import SnapshotTable

VERSION = semantic.IndexVersion("v1", "p", "m", 2, fields=frozenset({"k"}))


def _records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, start_ms long, json string").select("record_id", "start_ms", F.parse_json("json").alias("data"))


def test_semantic_search_joins_filters_and_breaks_ties(spark):
    rows = _records(spark, [(3, 5, '{"k": 1}'), (1, 5, '{"k": 1}'), (2, 4, '{"k": 1}'), (4, 0, '{"k": 2}'), (5, 0, "{}")])
    vectors = spark.createDataFrame([(i, [2.0, 0.0]) for i in (1, 2, 3, 4, 9)] + [(5, None)], "record_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = semantic.semantic_search(VERSION, rows, vectors, queries, 5, "p", "m", (("k", "eq", 1),)).collect()
    assert [(r.record_id, r.start_ms, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 4, 1.0), (1, 5, 1.0), (3, 5, 1.0)]
    for bad in (("q", "m", ()), ("p", "m", (("type", "eq", 1),))):
        with pytest.raises(ValueError):
            semantic.semantic_search(VERSION, rows, vectors, queries, 5, *bad)
    with pytest.raises(ValueError):
        semantic.semantic_search(semantic.IndexVersion("v", "p", "m", 2, semantic=False), rows, vectors, queries, 5, "p", "m")


def test_top_k_leaves_out_null_vectors_and_refuses_other_dimensions(spark):
    schema = "id string, source_file string, start_time double, end_time double, embedding array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    rows = [("a", "f", 0.0, 1.0, [1.0, 0.0]), ("b", "f", 1.0, 2.0, None), ("c", "f", 2.0, 3.0, [0.0, None]), ("d", "f", 3.0, 4.0, [0.0, 1.0])]
    got = search.top_k(spark.createDataFrame(rows, schema), queries, 9).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, "a"), (1, "d")]
    with pytest.raises(Exception, match="dimensions"):
        search.top_k(spark.createDataFrame([*rows, ("e", "f", 0.0, 1.0, [1.0])], schema), queries, 9).collect()


def test_vector_from_field(spark):
    df = _records(spark, [(1, 0, '{"a": {"v": [1, 2.5]}}'), (2, 0, '{"a": {"v": [1]}}'), (3, 0, '{"a": {}}'), (4, 0, '{"a": {"v": [1, "x"]}}')])
    v = semantic.vector_from_field(F.col("data"), "a.v", 2)
    assert df.filter("record_id = 1").select(v.alias("v")).first().v == [1.0, 2.5]
    for i in (2, 3, 4):
        with pytest.raises(Exception, match="a.v"):
            df.filter(F.col("record_id") == i).select(v).collect()


def test_unknown_ids_are_errors(spark):
    rows = spark.createDataFrame([(1, 9, 1), (1, 3, 2), (2, 1, 1)], "a long, start_ms long, s long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "a long")
    got = records.scan_records(rows, known.filter("a <> 2"), known, "a", "s").collect()
    assert sorted((r.a, r.place, r.start_ms) for r in got) == [(1, 1, 3), (1, 2, 9)]
    with pytest.raises(ValueError, match="unknown"):
        records.scan_records(rows, spark.createDataFrame([(8,)], "a long"), known, "a", "s")


def test_published_index_says_failed_without_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, 5, '{"t": "x y"}'), (2, 1, 5, 9, '{"t": "z"}')], "id long, media_id long, start_ms long, end_ms long, json string").withColumn("data", F.parse_json("json")).drop("json")
    definition = artifacts.IndexDefinition("d", "t", semantic_fields=("t",))
    built = artifacts.publish_index(rows, definition, 2, ingest.hashing_embedder(4), 4, f"{tmp_path}/a")
    assert [(r.records, r.vectors, r.status, r.version) for r in built.status.collect()] == [(2, 2, "ready", 2)]
    with pytest.raises(Exception, match="no valid vector"):
        artifacts.publish_index(rows, definition, 3, ingest.hashing_embedder(5), 4, f"{tmp_path}/b")
    with pytest.raises(ValueError, match="fields in no record"):
        artifacts.publish_index(rows, artifacts.IndexDefinition("d", "t", semantic_fields=("q",)), 1, ingest.hashing_embedder(4), 4, f"{tmp_path}/c")


def test_segments_of_two_media_may_share_an_id(spark):
    schema = "media_id string, key string, name string, artifact_type string, segment_id string, start_ms long, end_ms long, json string"
    rows = lambda *ids: spark.createDataFrame([(m, "k", "n", "t", s, 0, 5, "{}") for m, s in ids], schema).withColumn("data", F.parse_json("json")).drop("json")
    assert artifacts.invalid_records(rows(("a", "s"), ("b", "s"))).isEmpty()
    assert [r.problem for r in artifacts.invalid_records(rows(("a", "s"), ("a", "s"))).collect()] == ["duplicate segment"]
    one, two = (artifacts.request_hashes(rows(*x)).first().request_hash for x in ((("a", "s"), ("a", "t")), (("a", "t"), ("a", "s"))))
    assert one == two != artifacts.request_hashes(rows(("a", "s"))).first().request_hash


def test_snapshots_clear_and_categories(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", spark.createDataFrame([], "id long, x string").schema)
    assert t.clear() == 0
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"))
    assert t.clear() == 2 and t.read().count() == 0
    assert records.load_categories(spark, f"{tmp_path}/none").count() == 0


def test_letters_fold(spark):
    df = spark.createDataFrame([("ÀÉÎõü Straße ŁŒ Ž̌ ǅ",)], "x string").select(T.fold(F.col("x")).alias("f"), T.collapse_spaces(F.col("x")).alias("c")).first()
    assert df.f.startswith("aeiou straße ł") and df.c.startswith("àéîõü strasse ł")


def test_spaced_frames(spark):
    df = spark.createDataFrame([(0, 25.0), (1, 25.0), (10, 25.0)], "n int, fps double")
    got = [r.f for r in df.select(M.spaced_frames(F.col("n"), F.col("fps"), 4).alias("f")).collect()]
    assert got == [None, [0], [0, 3, 6, 9]]
    assert [r.f for r in df.select(M.spaced_frames(F.col("n"), F.col("fps"), 4, F.lit(0.2), F.lit(0.3)).alias("f")).collect()] == [None, [0], [5, 6]]


def test_overlapping_counts_a_pair_once(spark):
    rows = [(1, 1, 0.0, 95.0), (1, 2, 5.0, 50.0), (1, 3, 95.0, 99.0), (1, 4, 12.0, 12.0), (2, 5, 0.0, 95.0)]
    got = records.overlapping(spark.createDataFrame(rows, "g long, id long, s double, e double"), ["g"], 10.0).collect()
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r.id_a, r.id_b) for r in got) == want


def test_owned_files(spark):
    files = spark.createDataFrame([("/a/b/c.mp4",), ("/ab/c.mp4",), ("/a/x.mp4",), ("/d/e/f/g.mp4",)], "path string")
    roots = spark.createDataFrame([("/a/b/",), ("/a/b",), ("/d",)], "root string")
    assert sorted(r.path for r in media.owned(files, roots).collect()) == ["/a/b/c.mp4", "/d/e/f/g.mp4"]


def test_vectors_are_made_once_for_an_import(spark, tmp_path):
    own, asked = ingest.hashing_embedder(4), str(tmp_path / "asked")

    def embedder(texts):
        with open(asked, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return own(texts)

    media = spark.createDataFrame([(f"m{i}", 60_000, f"text {i}") for i in range(5)], "media_id string, duration_ms long, payload string")
    got = artifacts.understand(artifacts.vector_outputs(media, embedder, 4, "k", "clip"), spark.createDataFrame([], "media_id string, key string, request_hash string"))
    assert [x.count() for x in (got.runs, got.analyzers, got.artifacts, got.records, got.edges)] == [5, 5, 5, 15, 15]
    texts = open(asked).read().splitlines()
    assert len(texts) == len(set(texts)) == 15
