import os
import uuid

import numpy as np
import pytest

from momentlake.operators import search
from momentlake.plans import index_job, ingest
from momentlake.sources.index_store import IndexStore

CONFIG = index_job.IndexConfig(dimension=2, backend="b", model="m")
MEDIA = "source_file string, duration_ms long, payload string"


def embed(payloads):
    return np.array([[1.0, len(p)] for p in payloads])


def counting(folder):
    """Notes each payload that it embeds in a file of its own."""

    def run(payloads):
        for p in payloads:
            open(f"{folder}/{p.replace(':', '_')}-{uuid.uuid4().hex}", "w").close()
        return embed(payloads)

    return run


def test_statuses_reports_and_letters(spark, tmp_path):
    media = spark.createDataFrame([("/a", 75_000, "a"), ("/b", None, "b"), ("/c", 10_000, "bad"), ("/c", 10_000, "bad"), ("/d", 0, "d")], MEDIA)
    store = IndexStore(spark, f"{tmp_path}/store")

    def some(payloads):
        if any(p.startswith("bad") for p in payloads):
            raise ValueError("Invalid data in stream")
        return embed(payloads)

    spans = {(r.source_file, r.segment): r.id for r in index_job.expected_spans(media, CONFIG).collect()}
    still = spark.createDataFrame([(spans["/a", 1],)], "id string")
    r = index_job.run_index(media, store, some, CONFIG, still, now=7)
    assert (r.files, r.files_indexed, r.chunks_new, r.chunks_skipped, r.chunks_still, r.chunks_failed, r.chunks, r.total_chunks) == (4, 1, 2, 0, 1, 3, 6, 2)
    letters = {x.source_file: (x.error, x.attempts, x.last_attempt) for x in store.letters().collect()}
    assert letters == {"/b": ("file not found", 1, 7), "/c": ("Invalid data in stream", 1, 7), "/d": ("file not found", 1, 7)}
    again = index_job.run_index(media, store, some, CONFIG, still)
    assert (again.chunks_new, again.chunks_skipped, again.chunks_still, again.total_chunks) == (0, 5, 1, 2)
    retry = index_job.run_index(media, store, embed, index_job.IndexConfig(2, "b", "m", retry_failed=True), still, now=9)
    assert (retry.chunks_new, retry.chunks_failed, retry.total_chunks) == (1, 2, 3)
    assert {x.source_file: x.last_attempt for x in store.letters().collect()} == {"/b": 9, "/d": 9}
    assert store.chunks(1).count() == 2 and store.chunks(3).count() == 3
    with pytest.raises(ValueError):
        index_job.run_index(media, store, embed, index_job.IndexConfig(2, "b", "other"))


def test_an_empty_table_and_a_run_that_fails(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/store")
    r = index_job.run_index(spark.createDataFrame([], MEDIA), store, embed, CONFIG)
    assert (r.files, r.chunks, r.total_chunks, r.version) == (0, 0, 0, 1)
    broken = spark.createDataFrame([("/a", 75_000, "a")], MEDIA).selectExpr("source_file", "duration_ms", "raise_error('lost') as payload")
    with pytest.raises(Exception, match="lost"):
        index_job.run_index(broken, store, embed, CONFIG)
    assert store.version() == 1 and store.chunks().count() == 0


def test_permanent_errors_once_and_wrong_numbers_of_vectors(spark):
    calls = {"No such file": 1, "busy": 3}

    def some(values):
        if len(values) > 1:
            return embed(values)[:1]  # too few
        if values[0] in calls:
            raise RuntimeError(values[0])
        return embed(values) if values[0] != "two" else np.ones((2, 2))

    rows = spark.createDataFrame([("ok",), ("No such file",), ("busy",), ("two",)], "p string").coalesce(1)
    got = {r.p: (r.vector, r.error, r.attempts) for r in ingest.embed(rows, "p", some).collect()}
    assert got["ok"] == ([1.0, 2.0], None, 1) and got["No such file"] == (None, "No such file", 1) and got["busy"] == (None, "busy", 3)
    assert got["two"] == (None, "the embedder returned 2 vectors for 1", 3)


def test_cancel_resume_and_search_while_indexing(spark, tmp_path):
    schema = spark.createDataFrame([], MEDIA).schema
    for k in range(5):
        spark.createDataFrame([(f"/{k}{j}", 60_000, f"{k}{j}") for j in range(3)], MEDIA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/media")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/media")
    os.mkdir(f"{tmp_path}/calls")
    store, embedder, seen = IndexStore(spark, f"{tmp_path}/store"), counting(f"{tmp_path}/calls"), []
    asked = spark.createDataFrame([(1, [1.0, 4.0])], "query_id long, embedding array<double>")

    def look():
        """Before each batch: a search of what is stored by now, and of a version that was read before."""
        chunks = store.chunks()
        seen.append((chunks.count(), search.top_k(chunks, asked, 100).count(), store.chunks(1).count()))
        return len(seen) == 4

    first = index_job.run_index_stream(stream, store, embedder, CONFIG, f"{tmp_path}/checkpoint", look)
    assert first.cancelled and len(first.reports) == 3
    assert [s[0] for s in seen] == [0, 9, 18, 27] and all(a == b for a, b, _ in seen) and [s[2] for s in seen] == [0, 9, 9, 9]
    second = index_job.run_index_stream(stream, store, embedder, CONFIG, f"{tmp_path}/checkpoint")
    assert not second.cancelled and len(second.reports) == 2
    whole = IndexStore(spark, f"{tmp_path}/whole")
    index_job.run_index(spark.read.schema(schema).parquet(f"{tmp_path}/media"), whole, embed, CONFIG)
    assert sorted(map(str, store.chunks().collect())) == sorted(map(str, whole.chunks().collect()))
    names = [n.rsplit("-", 1)[0] for n in os.listdir(f"{tmp_path}/calls")]
    assert len(names) == len(set(names)) == 45


def test_a_published_batch_is_not_run_again(spark, tmp_path):
    spark.createDataFrame([("/a", 60_000, "a")], MEDIA).coalesce(1).write.parquet(f"{tmp_path}/media")
    stream = spark.readStream.schema(spark.createDataFrame([], MEDIA).schema).parquet(f"{tmp_path}/media")
    store = IndexStore(spark, f"{tmp_path}/store")
    index_job.run_index(spark.createDataFrame([("/z", 60_000, "z")], MEDIA), store, embed, CONFIG, batch="checkpoint:0")
    got = index_job.run_index_stream(stream, store, embed, CONFIG, f"{tmp_path}/checkpoint")
    assert got.reports == [] and store.version() == 1


def test_the_runs_of_a_query_share_their_media_and_still_spans(spark, monkeypatch):
    from momentlake.queries import jobs

    seen = []
    monkeypatch.setattr(index_job, "run_index", lambda media, store, embedder, config, still, now: seen.append(media.inputFiles() + still.inputFiles()))
    jobs._three_runs(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and all(seen) and not any("documents.parquet" in f for run in seen for f in run)  # each run read the documents twice before
