import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.operators import anomalies, frames, fulltext, fusion, records, search, structured
from momentlake.plans import artifacts, ingest
from momentlake.sources import snapshots


def chunk_rows(spark, rows):
    return spark.createDataFrame([(i, s, float(t), float(t + 5), [float(x) for x in v]) for i, s, t, v in rows], "id string, source_file string, start_time double, end_time double, embedding array<double>")


def query_rows(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def test_top_k_ties_scopes_and_empty(spark):
    c = chunk_rows(spark, [("b", "/b", 0, [1, 0]), ("a", "/a", 5, [1, 0]), ("c", "/a", 0, [1, 0]), ("d", "/d", 0, [0, 1])]).repartition(3)
    q = query_rows(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    got = search.top_k(c, q, 3).orderBy("query_id", "rank").collect()
    assert [r.id for r in got if r.query_id == 1] == ["c", "a", "b"] and got[3].id == "d" and got[3].distance == 0
    assert search.top_k(c, q, 0).count() == 0 and search.top_k(c, q.limit(0), 3).count() == 0
    none = spark.createDataFrame([], "source_file string")
    assert search.top_k(search.in_sources(c, none), q, 3).count() == 0
    many = query_rows(spark, [(i, [1.0, 0.0]) for i in range(50)])
    assert {r["count"] for r in search.top_k(c, many, 2, group_rows=7).groupBy("query_id").count().collect()} == {2}


def test_dedupe_keeps_first_and_third(spark):
    rows = [(0, 1, "x", [1.0, 0.0, 0.0]), (0, 2, "y", [0.99, 0.01, 0.0]), (0, 3, "z", [0.0, 1.0, 0.0])]
    hits = spark.createDataFrame(rows, "query_id long, rank int, id string, embedding array<double>")
    assert [r.id for r in search.dedupe_ranked(hits, 0.9, 3).orderBy("rank").collect()] == ["x", "z"]


def test_anomalies_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    kd = np.take_along_axis(d, near, 1)
    assert np.allclose([r.score for r in anomalies.knn_scores(df, 4).orderBy("id").collect()], kd.mean(1))
    lrd = 1 / (np.maximum(kd[near, -1], kd).mean(1) + 1e-12)
    want = lrd[near].mean(1) / (lrd + 1e-12)
    assert np.allclose([r.score for r in anomalies.lof_scores(df, 4).orderBy("id").collect()], want)
    assert [r.score for r in anomalies.lof_scores(df.limit(2), 4).collect()] == [0, 0]
    assert anomalies.exclude_baseline(df.limit(3), 5).count() == 3
    odd = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.01, 0.0]), (2, [0.98, 0.02, 0.0]), (3, [0.0, 1.0, 0.0])], "id long, embedding array<double>")
    best = anomalies.select_highlights(anomalies.centroid_scores(odd, 3), 2, 0.9).orderBy("rank").collect()
    assert best[0].id == 3 and len(best) == 2


DATA = ['{"k": 1, "s": "b", "tags": ["x", "y", "x"]}', '{"k": 2.5, "s": "a", "n": null}', '{"s": "c", "deep": {"v": true}}', '{"k": "1"}']


def test_structured(spark):
    df = spark.createDataFrame([(i, i, d) for i, d in enumerate(DATA)], "record_id long, start_ms long, data string").withColumn("data", F.parse_json("data"))

    def ids(*filters, sort=()):
        return [r.record_id for r in structured.run_query(df, structured.Query(filters, sort)).collect()]

    assert ids(("k", "eq", 1)) == [0] and ids(("k", "eq", "1")) == [3]
    assert ids(("k", "not_eq", 1)) == [1, 3]  # missing is false
    assert ids(("n", "eq", None)) == [1] and ids(("n", "not_eq", 1)) == [1]
    assert ids(("k", "in", [1, 2.5])) == [0, 1] and ids(("k", "in", "1")) == []
    assert ids(("k", "gte", 2)) == [1]
    assert ids(("s", "lt", "c")) == [0, 1]
    assert ids(("tags", "contains", "y")) == [0] and ids(("s", "contains", "c")) == [2]
    assert ids(("deep.v", "eq", True)) == [2] and ids(("s.v", "eq", 1)) == []
    assert ids(sort=(("s", "asc"),)) == [1, 0, 2, 3] and ids(sort=(("s", "desc"),)) == [3, 2, 0, 1]
    with pytest.raises(ValueError):
        ids(("k' or 1", "eq", 1))
    with pytest.raises(ValueError):
        structured.run_query(df, structured.Query((("k", "eq", 1),)), {"s"})
    assert [tuple(r) for r in structured.facet(df, "tags").collect()] == [('"x"', 2), ('"y"', 1)]
    assert [tuple(r) for r in structured.facet(df, "n").collect()] == [("null", 1)]


def test_fulltext_needs_all_terms_and_folds(spark):
    seg = spark.createDataFrame([(1, "/a", "Café ZEUS 742"), (2, "/b", "zeus 742 zeus"), (3, "/c", "zeus")], "id long, source_file string, text string")
    q = spark.createDataFrame([(1, "ZEUS-742"), (2, "cafe"), (3, "  "), (4, "absent zeus")], "query_id long, text string")
    got = {(r.query_id, r.id) for r in fulltext.search(seg, q, 5).collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}
    only = spark.createDataFrame([("/b",)], "source_file string")
    assert {r.id for r in fulltext.search(seg, q, 5, only).collect()} == {2}


def test_fulltext_scores_equal_queries_once(spark, monkeypatch):
    seg = spark.createDataFrame([(i, "/a", f"label part p{i % 50}") for i in range(400)], "id long, source_file string, text string")
    q = spark.createDataFrame([(i, "label p7 part" if i % 2 else "part label p7") for i in range(200)], "query_id long, text string")
    scored, rank = [], fulltext.rank_within
    monkeypatch.setattr(fulltext, "rank_within", lambda df, *a: (scored.append(df.count()), rank(df, *a))[1])
    rows = fulltext.search(seg, q, 3).collect()
    assert len(rows) == 600 and {(r["rank"], r.id) for r in rows} == {(1, 7), (2, 57), (3, 107)}
    assert scored == [8]  # 1,600 before


def test_a_norm_is_taken_once_a_vector(spark):
    from momentlake.functions import vectors

    plan = spark.range(1).select(vectors.l2_normalize(F.array(F.col("id").cast("double"), F.lit(2.0))).alias("v"))
    assert plan.first().v == [0.0, 1.0]
    assert "struct(" in plan._jdf.queryExecution().analyzed().toString()  # the norm is bound outside of the function of components


def _fuse(lists, n):
    """The same in plain Python: hits in order of lists and ranks, merged per source."""
    found = []
    for name in fusion.WEIGHTS:
        for r in sorted((x for x in lists if x[0] == name), key=lambda x: x[1]):
            _, rank, src, a, b, score, mod, text = r
            w, exact = fusion.WEIGHTS[name], name == "exact"
            rrf, pri, ev = w / (60 + rank), 1.0 if exact else w * score, 2.0 if exact else max(score, 0)
            hit = next((c for c in found if name != "visual" and c["src"] == src and max(0, min(c["gb"], b) - max(c["ga"], a)) / max(min(c["gb"] - c["ga"], b - a), 0.001) >= 0.2), None)
            if hit is None:
                found.append({"src": src, "ga": a, "gb": b, "a": a, "b": b, "rrf": rrf, "pri": pri, "mod": "visual" if name == "visual" else mod, "text": None if name == "visual" else text, "ev": 0 if name == "visual" else ev})
                continue
            hit.update(ga=min(hit["ga"], a), gb=max(hit["gb"], b), rrf=hit["rrf"] + rrf)
            if pri > hit["pri"]:
                hit.update(pri=pri, mod=mod, a=a, b=b)
            if ev > hit["ev"] and text:
                hit.update(ev=ev, text=text)
    found.sort(key=lambda c: -c["rrf"])
    return [(c["src"], c["a"], c["b"], round(min(c["rrf"] * 61, 1), 9), c["mod"], c["text"]) for c in found[:n]]


def test_fusion_against_plain_python(spark):
    rng = random.Random(1)
    lists = [(name, rank, f"/{rng.randrange(3)}.mp4", float(a := rng.randrange(40)), float(a + rng.randrange(1, 20)), round(rng.random(), 3), name, f"{name} {rank}") for name in fusion.WEIGHTS for rank in range(1, 9)]
    df = spark.createDataFrame([(0, *x) for x in lists], "query_id long, list string, rank int, source_file string, start_time double, end_time double, score double, modality string, text string").repartition(3)
    got = [(r.source_file, r.start_time, r.end_time, round(r.score, 9), r.primary_modality, r.evidence) for r in fusion.fuse(df, 50).orderBy("rank").collect()]
    assert sorted(got, key=str) == sorted(_fuse(lists, 50), key=str)
    assert [g[3] for g in got] == sorted((g[3] for g in got), reverse=True)


def _frame(span, i, color, size=4):
    return (span, i, size, size, bytes(color) * (size * size))


def test_frames(spark):
    rows = [_frame(0, 0, (220, 5, 5)), _frame(0, 1, (220, 5, 5)), _frame(1, 0, (5, 220, 5)), *(_frame(2, i, (20 if i % 2 else 235,) * 3) for i in range(8)), *(_frame(3, i, (128,) * 3) for i in range(8)), _frame(4, 0, (5, 5, 5)), _frame(5, 0, (250, 250, 250))]
    df = spark.createDataFrame([(s, i, w, h, bytearray(b)) for s, i, w, h, b in rows], "span_id long, frame_idx int, width int, height int, rgb binary").repartition(3)
    f = {r.span_id: np.array(r.embedding) for r in frames.span_features(df).collect()}
    q = {r.query_id: np.array(r.embedding) for r in frames.text_features(spark.createDataFrame([(0, "red car"), (1, "dark night"), (2, "fast moving action")], "query_id long, text string")).collect()}
    assert all(len(v) == 124 for v in (*f.values(), *q.values()))
    assert q[0] @ f[0] > q[0] @ f[1] and q[1] @ f[4] > q[1] @ f[5] and q[2] @ f[2] > q[2] @ f[3]
    assert sorted(r.span_id for r in anomalies.still_spans(df).collect()) == [0, 3]
    kept = {(r.span_id, r.frame_idx) for r in frames.changed_frames(df).collect()}
    assert (0, 1) not in kept and (2, 7) in kept and sum(s == 3 for s, _ in kept) == 1
    diffs = {(r.span_id, r.frame_idx): r.difference for r in frames.frame_differences(df).collect()}
    assert diffs[0, 0] is None and diffs[0, 1] == 0 and abs(diffs[2, 1] - 215 / 255) < 1e-9


def test_understand_and_index(spark):
    rows = [("m", "k", "scene", "scene", "s0", 0, 5000, '{"activity": "walking", "list": ["a", " "]}'), ("m", "k", "scene", "scene", "s1", 5000, 10000, '{"activity": "cycling"}'), ("m", "k", "objects", "objects", "s0", 2000, 6000, '{"label": "bike"}')]
    out = spark.createDataFrame(rows, "media_id string, key string, name string, artifact_type string, segment_id string, start_ms long, end_ms long, data string").withColumn("data", F.parse_json("data"))
    none = spark.createDataFrame([], "media_id string, key string, request_hash string")
    got = artifacts.understand(out, none)
    assert [x.count() for x in (got.runs, got.analyzers, got.artifacts, got.records, got.edges)] == [1, 2, 2, 3, 5]
    assert artifacts.understand(out, got.runs).records.count() == 0
    with pytest.raises(ValueError):
        artifacts.understand(out.filter("name = 'scene'"), got.runs)
    with pytest.raises(ValueError):
        artifacts.understand(out.union(out), none)
    with pytest.raises(ValueError):
        artifacts.understand(out.withColumn("end_ms", F.lit(0)), none)
    scene = got.records.join(got.artifacts.filter("artifact_type = 'scene'").select(F.col("id").alias("artifact_id")), "artifact_id")
    index = artifacts.build_index(scene, artifacts.IndexDefinition("i", "scene", ("activity", "list")), 1)
    assert [r.semantic_text for r in index.orderBy("start_ms").collect()] == ["activity: walking\nlist: a", "activity: cycling"]
    with pytest.raises(ValueError):
        artifacts.build_index(scene, artifacts.IndexDefinition("i", "scene", ("absent",)), 1)


def test_ingest_retries_and_dead_letters(spark):
    calls = ingest.hashing_embedder(8)

    def embedder(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("could not decode " + "x" * 1000)
        return calls(texts)

    rows = spark.createDataFrame([(f"i{k}", "/a", float(k), float(k + 1), "bad" if k == 2 else f"text {k}") for k in range(5)], "id string, source_file string, start_time double, end_time double, payload string")
    stored, failed = spark.createDataFrame([("i0",)], "id string"), spark.createDataFrame([], "id string")
    got = ingest.build(rows, stored, failed, embedder, 8)
    assert sorted(r.id for r in got.chunks.collect()) == ["i1", "i3", "i4"]
    bad = got.failed.collect()
    assert [(r.id, r.attempts, len(r.error)) for r in bad] == [("i2", 1, 500)]  # its error is permanent
    again = got.failed.withColumn("error", F.lit("new")).withColumn("start_time", F.lit(9.0))
    merged = ingest.dead_letters(got.failed, again).collect()
    assert [(r.error, r.start_time) for r in merged] == [("new", 2.0)]
    assert records.pending(rows, stored, got.failed).count() == 3 and records.pending(rows, stored, got.failed, retry_failed=True).count() == 4
    with pytest.raises(ValueError):
        ingest.check_compatible(spark.createDataFrame([("b", "m")], "backend string, model string"), "b", "other")


def test_snapshots_and_stream(spark, tmp_path):
    from momentlake.streaming.ingest import first_seen, ingest as start, read_records

    schema = spark.createDataFrame([], "id string, value long").schema
    t = snapshots.SnapshotTable(spark, str(tmp_path / "t"), schema)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1), ("b", 2)], schema))
    held = t.read()
    t.upsert(spark.createDataFrame([("b", 3), ("c", 4)], schema))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, held.collect())) == [("a", 1), ("b", 2)]
    t.insert_absent(spark.createDataFrame([("c", 9), ("d", 5)], schema), "id")
    assert t.remove("id = 'a'") == 1 and t.remove("id = 'zz'") == 0
    assert sorted(map(tuple, t.read().collect())) == [("b", 3), ("c", 4), ("d", 5)]
    spark.createDataFrame([("d", 6), ("e", 7), ("e", 7)], schema).write.parquet(str(tmp_path / "in"))
    for turn in "xy":
        start(read_records(spark, str(tmp_path / "in"), schema), t, str(tmp_path / turn)).awaitTermination()
    assert sorted(map(tuple, t.read().collect())) == [("b", 3), ("c", 4), ("d", 6), ("e", 7)]
    assert first_seen(spark.read.parquet(str(tmp_path / "in")), "id").count() == 2


def test_quality_and_resolution(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (2, 3, "b")], "query_id long, rank int, answer string")
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, expected string")
    r = records.retrieval_quality(results, truth, (1, 5)).first()
    assert (r.queries, round(r.hit_at_1, 4), round(r.hit_at_5, 4), round(r.mrr, 4), round(r.empty_rate, 4)) == (3, 0.3333, 0.6667, 0.4444, 0.3333)
    versions = spark.createDataFrame([(1, "n", 1, "ready"), (2, "n", 2, "ready"), (3, "n", 3, "building")], "index_version_id long, name string, version long, status string")
    aliases = spark.createDataFrame([("live", 2, 5), ("live", 1, 9), ("live", 3, 10)], "alias string, index_version_id long, updated_at long")
    names = spark.createDataFrame([("n",), ("live",), ("none",)], "name string")
    assert {r.name: r.index_version_id for r in records.resolve(versions, aliases, names).collect()} == {"n": 2, "live": 1, "none": None}


def test_manifest_alias_and_stats(spark, tmp_path):
    import json

    from momentlake.sources.manifests import read_manifests

    record = {"segment_id": "s0", "start_ms": 0, "end_ms": 5000, "data": {"activity": "walking", "list": [1, 2]}, "metadata": {}}
    (tmp_path / "m.json").write_text(json.dumps([{"name": "scene", "analyzer_type": "x", "config": {"a": 1}, "artifact_type": "scene", "schema_version": 1, "schema_definition": {}, "records": [record, {**record, "segment_id": "s1"}]}]))
    rows = read_manifests(spark, str(tmp_path / "m.json"), "m", "k")
    got = artifacts.understand(rows, spark.createDataFrame([], "media_id string, key string, request_hash string"))
    assert got.records.count() == 2 and rows.filter(structured.predicate(F.col("data"), "list", "contains", 2)).count() == 2
    versions = spark.createDataFrame([(1, "ready"), (2, "building")], "index_version_id long, status string")
    log = spark.createDataFrame([], "alias string, index_version_id long, updated_at long")
    assert records.activate(log, versions, "live", 1, 5).count() == 1
    with pytest.raises(ValueError):
        records.activate(log, versions, "live", 2, 6)


def segments_stay_where_they_are(spark, name):
    from momentlake.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.lstrip(" :+-*()0123456789") for line in plan.splitlines()]
    shuffles = [line for line in lines if line.startswith("Exchange")]
    return len(shuffles) == sum(line.startswith("Generate explode") for line in lines) and all("REPARTITION_BY_NUM" in line for line in shuffles)


def test_files_are_complete_without_a_shuffle_of_their_segments(spark):
    assert segments_stay_where_they_are(spark, "j7_complete_files")
    rows = spark.createDataFrame([("/a", "a0"), ("/a", "a1"), ("/b", "b0"), ("/b", "b1"), ("/c", "c0"), ("/d", None)], "source_file string, id string")
    stored = spark.createDataFrame([("/a", "a0"), ("/a", "a1"), ("/a", "a9"), ("/b", "b1"), ("/b", "b1"), ("/c", None), ("/d", None), ("/e", "e0")], "source_file string, id string")
    for known in (stored, stored.select("id")):
        assert [r.source_file for r in records.complete_files(rows, known).collect()] == ["/a"]


def test_pending_chunks_without_a_shuffle_of_them(spark):
    assert segments_stay_where_they_are(spark, "j7_pending")
    rows = spark.createDataFrame([("/a", "a0", 1), ("/a", "a1", 2), ("/a", "a1", 3), ("/b", "b0", 4), ("/b", None, 5), ("/c", "c0", 6)], "source_file string, id string, n int")
    stored = spark.createDataFrame([("/a", "a0"), ("/a", "a0"), ("/b", None), ("/e", "e0")], "source_file string, id string")
    failed = spark.createDataFrame([("/b", "b0")], "source_file string, id string")
    for a, b in ((stored, failed), (stored.select("id"), failed), (stored.select("id"), failed.select("id"))):
        left, again = records.pending(rows, a, b), records.pending(rows, a, b, retry_failed=True)
        assert left.columns == again.columns and {*left.columns} == {*rows.columns}
        assert sorted(r.n for r in left.collect()) == [2, 3, 5, 6] and sorted(r.n for r in again.collect()) == [2, 3, 4, 5, 6]
