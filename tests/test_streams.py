import random

from pyspark.sql import functions as F

from momentlake.streaming import ingest, keyed

EVENT = "ts timestamp, event_type string, value double"


def written(spark, rows, schema, path, cuts):
    """Rows as a stream of a file for each run of cuts."""
    df = spark.createDataFrame(rows, schema)
    at = 0
    for n in cuts:
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(path)
        at += n
    return ingest.read_records(spark, path, df.schema, files_per_trigger=1)


def test_best_rows_are_the_same_for_any_cut(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}", rng.randrange(50), rng.choice("abc")) for _ in range(60)] + [(None, 3, "x")]
    want = {}
    for k, at, x in rows:
        want[k] = min(want.get(k, (99, "")), (at, x))
    for n, cuts in enumerate(([61], [20, 1, 40], [5, 50, 6])):
        rng.shuffle(rows)
        home, schema = f"{tmp_path}/{n}", "k string, at long, x string"
        stream = written(spark, rows, schema, f"{home}/in", cuts)
        keyed.keep_best(stream, f"{home}/out", f"{home}/checkpoint", "k", ["at"]).awaitTermination()
        assert {r.k: (r.at, r.x) for r in keyed.stored_best(spark, f"{home}/out", schema, "k", ["at"]).collect()} == want
        again = spark.createDataFrame([("k1", -5, "z")], schema)
        again.coalesce(1).write.mode("append").parquet(f"{home}/in")
        keyed.keep_best(stream, f"{home}/out", f"{home}/checkpoint", "k", ["at"]).awaitTermination()
        assert spark.read.parquet(f"{home}/out/batch={len(cuts)}").count() == 1  # a batch stores what it changed, not what there is
        assert {r.k: r.at for r in keyed.stored_best(spark, f"{home}/out", schema, "k", ["at"]).collect()}["k1"] == -5


def test_windows_close_once_and_late_rows_are_kept(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    batches = [[(at(1), "a", 1.0), (at(29), "a", 2.0), (None, "a", 9.0)], [(at(200), "a", 4.0), (at(26), "a", 3.0)], [(at(3), "a", 7.0), (at(190), "b", None)], [(at(5_000), None, None)]]
    rows = [r for b in batches for r in b]
    stream = written(spark, rows, EVENT, f"{tmp_path}/in", [len(b) for b in batches])
    store = keyed.WindowStore(spark, f"{tmp_path}/store")
    keyed.window_counts(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    from_zero = F.unix_millis("window_start")
    first = store.closed().agg(F.min(from_zero)).first()[0]
    closed = {((r.at - first) // 1000, r.event_type): (r.n, r.total) for r in store.closed().select(from_zero.alias("at"), "event_type", "n", "total").collect()}
    late = [((r.at - first) // 1000, r.value) for r in store.late().select(from_zero.alias("at"), "value").collect()]
    assert store.closed().groupBy("window_start", "event_type").count().filter("count > 1").count() == 0
    batch = ingest.sliding_counts(spark.createDataFrame(rows, EVENT)).filter("event_type is not null")
    whole = {((r.at - first) // 1000, r.event_type): (r.n, r.total or 0.0) for r in batch.select(F.unix_millis("window_start").alias("at"), "event_type", "n", "total").collect()}
    for key, (n, total) in whole.items():
        own = closed.get(key, (0, 0.0))
        extra = [v for w, v in late if (w, "a") == key]
        assert (own[0] + len(extra), own[1] + sum(extra)) == (n, total), key
    assert {v for _, v in late} == {7.0} and all(v[0] for v in closed.values())
    before = sorted(map(str, store.closed().collect()))
    store.add(spark.createDataFrame(batches[1], EVENT), 1)  # a batch that runs twice changes nothing
    assert sorted(map(str, store.closed().collect())) == before


def test_batches_of_several_files(spark, tmp_path):
    parts = [spark.range(1000, 1060), spark.range(1).filter("id < 0"), spark.range(3)]
    files = ingest.write_batches(parts, f"{tmp_path}/in")
    assert files == 4  # the cores; one file, so one task, a batch before
    schema, seen = parts[0].schema, []
    stream = ingest.read_records(spark, f"{tmp_path}/in", schema, files_per_trigger=files)
    note = lambda batch, _: seen.append(sorted(r.id for r in batch.collect()))
    stream.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(1000, 1060)), [], [0, 1, 2]] and len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) == 12


def test_metrics_of_more_than_a_hundred_batches(spark, tmp_path):
    rows = [(i, "x") for i in range(104)]
    for i in range(104):
        spark.createDataFrame(rows[i : i + 1], "id long, x string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.read_records(spark, f"{tmp_path}/in", spark.createDataFrame(rows, "id long, x string").schema, files_per_trigger=1)
    with keyed.MetricsTable(spark, f"{tmp_path}/metrics") as metrics:
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = metrics.of(query).filter("rows > 0").agg(F.count_distinct("batch").alias("batches"), F.sum("rows").alias("rows")).first()
    assert (seen.batches, seen.rows) == (104, 104)


def test_live_categories_merge_over_batches(spark, tmp_path):
    rows = [("f", [1.0, 0.0]), ("g", [0.0, 1.0]), ("f", [0.6, 0.8]), ("g", [0.1, 1.0]), ("h", [1.0, 1.0])]
    stream = written(spark, rows, "source_file string, embedding array<double>", f"{tmp_path}/in", [2, 1, 2])
    named = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.0, 1.0])], "position long, name string, centre array<double>")
    from momentlake.functions import vectors as V

    ingest.live_categories(stream, named, V.cosine(F.col("embedding"), F.col("centre")), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.path: r.category for r in ingest.stored_categories(spark, f"{tmp_path}/out").collect()} == {"f": "x", "g": "y", "h": "x"}
