"""Index versions, enrichment search, imports, folders, dead letters and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import moments as M
from momentlake.functions import text as T
from momentlake.functions import vectors as V
from momentlake.operators import fusion, multimodal, records, search, semantic
from momentlake.plans import artifacts, ingest
from momentlake.queries._tables import ASKED, CHUNKS, RECORDS, asked, chunks, event_records, r6, table
from momentlake.sources import media
from momentlake.sources.shared import shared_path
from momentlake.sources.snapshots import SnapshotTable
from momentlake.streaming import ingest as streams
from momentlake.streaming import keyed

MODALITIES = ("scene_caption", "ocr", "transcript")


def a14_semantic_index(spark: SparkSession, d: str) -> DataFrame:
    """Events as an index version, with the vectors of those that have one."""
    version = semantic.IndexVersion("index_events", "table", "unit64", 64, fields=frozenset({"k", "type"}))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    hits = semantic.semantic_search(version, event_records(spark, d), vectors, asked(spark, d), 5, "table", "unit64", (("k", "gte", 10),))
    return hits.select("query_id", "rank", "record_id", "start_ms", r6("score").alias("score"))


def a14_built_index(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as records of an artifact: imported, built to an index version, published, and searched."""
    data = F.parse_json(F.to_json(F.struct(F.col("embedding").alias("vector"), F.col("label"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"))))
    start = (F.col("vec_id") % 1000) * 1000
    rows = table(spark, d, "embeddings").select(F.lit("media_1").alias("media_id"), F.lit("nightly").alias("key"), F.lit("clip").alias("name"), F.lit("vectors").alias("artifact_type"), F.format_string("segment_%08d", "vec_id").alias("segment_id"), start.alias("start_ms"), (start + 1000).alias("end_ms"), data.alias("data"))
    got = artifacts.understand(rows, spark.createDataFrame([], "media_id string, key string, request_hash string"))
    stored = lambda df, name: (df.write.parquet(f"{home}/{name}"), spark.read.schema(df.schema).parquet(f"{home}/{name}"))[1]
    home = shared_path(spark, "imported")
    records_, artifacts_ = stored(got.records, "records"), stored(got.artifacts, "artifacts")
    definition = artifacts.IndexDefinition("vectors", "vectors", filter_fields=("label",), source_embedding_field="vector")
    built = artifacts.publish_index(records_, definition, 1, ingest.hashing_embedder(8), 64, shared_path(spark, "index"), artifacts_)
    version = semantic.IndexVersion(built.status.first().index_version_id, "table", "unit64", 64, fields=frozenset(definition.filter_fields))
    named = lambda df: df.withColumnRenamed("artifact_record_id", "record_id")
    hits = semantic.semantic_search(version, named(built.index), named(built.embeddings), asked(spark, d), 5, "table", "unit64", (("label", "gte", 3),))
    segments = records_.select(F.col("id").alias("record_id"), "segment_id")
    return hits.join(segments, "record_id").select("query_id", "start_ms", r6("score").alias("score")).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("fifth"), r6(F.sum("score")).alias("all"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as enrichment texts: three modalities, every fifth of another backend, every seventh of another dimension."""
    v = F.col("vec_id")
    modality = F.element_at(F.array(*(F.lit(m) for m in MODALITIES)), (v % 3 + 1).cast("int"))
    cut = F.when(v % 7 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return chunks(spark, d).withColumns({"modality": modality, "backend": F.when(v % 5 == 0, "other").otherwise("table"), "model": F.lit("unit64"), "embedding": cut})


def a15_enrichment_topk(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "nation").select(F.format_string("/lib/%02d.mp4", "n_nationkey").alias("source_file"))
    hits = semantic.enrichment_search(_segments(spark, d), asked(spark, d), 5, "table", "unit64", MODALITIES, sources)
    return hits.select("query_id", F.col("list").alias("modality"), "rank", "id", r6("score").alias("score"))


def a17_fused_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole fused search: visual list, three enrichment lists, plain reciprocal ranks by id."""
    visual = search.top_k(chunks(spark, d), asked(spark, d), fusion.depth(5)).withColumn("list", F.lit("visual"))
    texts = semantic.enrichment_search(_segments(spark, d), asked(spark, d), fusion.depth(5), "table", "unit64", MODALITIES)
    fused = fusion.reciprocal_rank(visual.unionByName(texts), 5)
    return fused.select("query_id", "rank", "id", r6("score").alias("score"))


def a17_multimodal(spark: SparkSession, d: str) -> DataFrame:
    """The whole search, in sources of the library that are asked for: five lists, the exact one included, and moments merged."""
    text = lambda label, n: F.concat(F.lit("label l"), label.cast("string"), F.lit(" part p"), (n % 10).cast("string"))
    segments = _segments(spark, d).withColumn("text", text(F.col("label"), F.col("vec_id")))
    queries = asked(spark, d).withColumn("text", text(F.col("label"), F.floor(F.col("query_id") / 20)))
    sources = table(spark, d, "nation").select(F.format_string("/lib/%02d.mp4", "n_nationkey").alias("source_file"))
    out = multimodal.search_moments(chunks(spark, d), segments, queries, 5, "table", "unit64", sources)
    scores = [r6(F.col("score_breakdown")[x]).alias(f"{x}_score") for x in ("visual", *MODALITIES, "exact")]
    return out.select("query_id", "rank", "source_file", "start_time", "end_time", r6("score").alias("score"), "primary_modality", "evidence", *scores)


def a18_visual_only(spark: SparkSession, d: str) -> DataFrame:
    """Fused search while no text is stored: the visual list as it is."""
    listed = lambda df, name: df.select("query_id", "rank", "source_file", "start_time", "end_time", "score", F.lit(name).alias("list"), F.lit(name).alias("modality"), F.lit("").alias("text"))
    visual = listed(search.top_k(chunks(spark, d), asked(spark, d), fusion.depth(5)), "visual")
    none = _segments(spark, d).filter("model = 'never stored'")
    found = semantic.fused_or_visual(visual, visual.limit(0), none, 5)
    return found.select("query_id", "rank", "source_file", "start_time", "end_time", r6("score").alias("score"), "primary_modality")


def p7_vector_from_field(spark: SparkSession, d: str) -> DataFrame:
    data = F.parse_json(F.to_json(F.struct(F.struct("embedding").alias("detail"))))
    v = semantic.vector_from_field(data, "detail.embedding", 64)
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", r6(F.col("v")[0].cast("double")).alias("first"), r6(F.col("v")[63].cast("double")).alias("last"), r6(V.dot(F.col("v"), F.col("v"))).alias("square"))


def i6_index_build(spark: SparkSession, d: str) -> DataFrame:
    """Events built and published as an index version, vectors and all."""
    rows = event_records(spark, d).withColumnRenamed("record_id", "id")
    definition = artifacts.IndexDefinition("events", "event", semantic_fields=("type", "tags", "detail.kind"), filter_fields=("k",))
    built = artifacts.publish_index(rows, definition, 1, ingest.hashing_embedder(32), 32, shared_path(spark, "index"))
    texts = built.embeddings.agg(F.count_distinct("source_text_hash").alias("texts"), F.min("field_name").alias("field_name"))
    return built.status.crossJoin(texts).select("name", "version", "records", "vectors", "status", "texts", "field_name")  # a row each


def i5_vector_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Orders as media: a vector for each of the first four spans, imported as an artifact."""
    rows = table(spark, d, "orders").select(F.format_string("media_%d", "o_orderkey").alias("media_id"), F.round("o_totalprice").cast("long").alias("duration_ms"), F.col("o_orderpriority").alias("payload"))
    outputs = artifacts.vector_outputs(rows, ingest.hashing_embedder(8), 8, "nightly", "clip", max_segments=4)
    got = artifacts.understand(outputs, spark.createDataFrame([], "media_id string, key string, request_hash string"))
    size = F.size(semantic.vector_from_field(F.col("data"), "vector", 8))
    return got.records.groupBy("media_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("last_ms"), F.min(size).alias("dimension"))


def i7_modality_jobs(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("media_id"))
    modality = F.when(F.col("o_custkey") % 2 == 0, "nightly:ocr").otherwise("nightly:transcript")
    runs = table(spark, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("media_id"), modality.alias("key"))
    return records.modality_jobs(customers, MODALITIES, "nightly", runs)


def s7_artifact_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_partkey").alias("start_ms"), F.col("l_linenumber").alias("segment_id"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), "o_orderstatus")
    return records.scan_records(rows, orders.filter("o_orderstatus = 'F'"), orders, "artifact_id", "segment_id")


def s8_index_records(spark: SparkSession, d: str) -> DataFrame:
    rows = event_records(spark, d).select(F.col("media_id").alias("index_version_id"), "start_ms", "record_id")
    known = rows.select("index_version_id").distinct()
    return records.scan_records(rows, known.filter("index_version_id % 2 = 0"), known, "index_version_id", "record_id")


def j1_artifacts_of_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("analyzer_run_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("artifact_id"))
    analyzers = table(spark, d, "orders").select(F.col("o_orderkey").alias("analyzer_run_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name"))
    runs = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("run_id"))
    return records.artifacts_of_runs(rows, analyzers, runs).select("artifact_id", "run_id", "name")


def j2_versions_with_definitions(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("definition_id"))
    definitions = table(spark, d, "customer").select(F.col("c_custkey").alias("definition_id"), F.col("c_mktsegment").alias("artifact_type"))
    return records.versions_with_definitions(versions, definitions).select("version_id", "definition_id", "artifact_type")


def j12_missing_sources(spark: SparkSession, d: str) -> DataFrame:
    scanned = table(spark, d, "nation").select(F.format_string("/lib/%02d.mp4", "n_nationkey").alias("path"))
    return media.missing_sources(chunks(spark, d).select("source_file", "id"), scanned).select("id", "source_file")


def s3_register(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: one medium for each content that no page has."""
    files = table(spark, d, "documents").select(F.format_string("/in/%08d.mp4", "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    known = table(spark, d, "pages").select(F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("content_hash"))
    return media.register(files, known)


def s10_remove_and_clear(spark: SparkSession, d: str) -> DataFrame:
    """Turns as a snapshot table: those of users removed, the rest cleared."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    stored = SnapshotTable(spark, shared_path(spark, "turns"), rows.schema)
    stored.overwrite(rows)
    removed = stored.remove("role = 'user'")
    left = stored.read().groupBy("role").agg(F.count("*").alias("n"))
    cleared = stored.clear()
    return left.select("role", "n", F.lit(removed).cast("long").alias("removed"), F.lit(cleared).cast("long").alias("cleared"), F.lit(stored.read().count()).cast("long").alias("left"))


def s11_categories(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "categories")
    rows = table(spark, d, "documents").select(F.format_string("/in/%08d", "doc_id").alias("path"), F.col("lang").alias("category"))
    empty = records.load_categories(spark, path)
    records.save_categories(rows.unionByName(empty), path)
    return records.load_categories(spark, path)


def f9_category(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    one, every = semantic.in_category(rows, "BUILDING"), semantic.in_category(rows, "All")
    return one.withColumn("kind", F.lit("one")).unionByName(every.withColumn("kind", F.lit("all"))).select("kind", "c_custkey")


def u4_owned_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files in folders of region and nation; some nations' and one region's folders are roots."""
    nation = table(spark, d, "nation")
    folder = F.format_string("/lib/r%d/n%d", "n_regionkey", "n_nationkey")
    files = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(folder, F.format_string("/c%d.mp4", "c_custkey")).alias("path"))
    roots = nation.filter("n_nationkey % 3 = 0").select(F.concat(folder, F.lit("/")).alias("root")).unionByName(table(spark, d, "region").filter("r_regionkey = 1").select(F.format_string("/lib/r%d", "r_regionkey").alias("root")))
    return media.owned(files, roots)


def i3_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders as letters, upserted with failures of urgent ones; those of every fourth customer are removed."""
    o = table(spark, d, "orders")
    columns = [F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_file"), F.lit(0.0).alias("start_time"), F.lit(30.0).alias("end_time")]
    old = o.filter("o_orderstatus = 'F'").select(*columns, F.lit("old").alias("error"), F.lit(1).alias("attempts"), F.lit(1).alias("last_attempt"))
    new = o.filter("o_orderpriority like '1%'").select(*columns, F.lit("new").alias("error"), F.lit(3).alias("attempts"), F.lit(2).alias("last_attempt"))
    left = ingest.without_dead_letters(ingest.dead_letters(old, new), o.filter("o_custkey % 4 = 0").select(columns[0]))
    return ingest.list_dead_letters(left).select("id", "source_file", "error", "attempts", "last_attempt")


def p22_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.fold(F.col("text")), "UTF-8")).alias("folded"))


def a23_spaced_frames(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    n, fps, start = (F.col("o_totalprice").cast("int") % 700), (F.col("o_custkey") % 5 + 20).cast("double"), (F.col("o_orderkey") % 9).cast("double")
    return o.select("o_orderkey", F.array_join(M.spaced_frames(n, fps, 8, start, start + 10), " ").alias("frames"), M.spaced_count(n, fps, 500).alias("whole"))


def _event_files(spark: SparkSession, d: str, n: int, late: int = 0) -> DataFrame:
    """Events as a stream of n batches, by parts of the time that they span; every 50th comes `late` batches later, and after all of them one without a type, a day on."""
    path, events = shared_path(spark, "events"), table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - low) * n / (high - low + 1)) + F.when(F.col("event_id") % 50 == 0, late).otherwise(0), F.lit(n - 1))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(high + 86_400_000_000)).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    files = streams.write_batches([*(events.filter(part == k) for k in range(n)), end], path)
    return streams.read_records(spark, path, events.schema, files_per_trigger=files)


def _first_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream in files that go back in time, one a batch; of each user the first event."""
    home, rank = shared_path(spark, "seen"), ["us", "event_id"]
    events = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("us"), "event_id")
    files = streams.write_batches([events.filter(F.pmod("event_id", F.lit(4)) == 3 - k) for k in range(4)], f"{home}/in")
    rows = streams.read_records(spark, f"{home}/in", events.schema, files_per_trigger=files)
    keyed.keep_best(rows, f"{home}/out", f"{home}/checkpoint", "user_id", rank).awaitTermination()
    return keyed.stored_best(spark, f"{home}/out", "user_id long, us long, event_id long", "user_id", rank)


def t2_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, each user once."""
    return _first_events(spark, d).select("user_id")


def t2_first_events(spark: SparkSession, d: str) -> DataFrame:
    return _first_events(spark, d)


def t3_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream that closes them under a watermark: what each had when it was closed and what came late for it."""
    home = shared_path(spark, "windows")
    store = keyed.WindowStore(spark, f"{home}/store", "6 hours", "5 hours", delay_ms=3_600_000)
    keyed.window_counts(_event_files(spark, d, 4, late=2), store, f"{home}/checkpoint").awaitTermination()
    keys = [F.unix_micros("window_start").alias("window_start"), F.col("event_type")]
    closed = store.closed().filter("event_type is not null").groupBy(*keys).agg(F.count("*").alias("times"), F.sum("n").alias("n"), r6(F.sum("total")).alias("total"))
    late = store.late().groupBy(*keys).agg(F.count("*").alias("late"))
    out = closed.join(late, ["window_start", "event_type"], "full_outer")
    return out.select("window_start", "event_type", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("times", "n", "late")), F.coalesce("total", F.lit(0.0)).alias("total"))


def t4_progress(spark: SparkSession, d: str) -> DataFrame:
    """What the metrics of a stream over documents say."""
    home = shared_path(spark, "progress")
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    rows = streams.read_records(spark, f"{d}/documents.parquet*", schema).select("doc_id")
    with keyed.MetricsTable(spark, f"{home}/metrics") as metrics:
        query = rows.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = metrics.of(query)
        return seen.agg(F.sum("rows").alias("rows"), (F.count_if(F.col("rows") > 0) > 0).alias("any"))


def t5_live_categories(spark: SparkSession, d: str) -> DataFrame:
    """Chunks come in as a stream; the best category of each file, merged with what its earlier chunks gave."""
    home = shared_path(spark, "live")
    mean = V.component_mean(F.col("embedding"), 64)
    named = table(spark, d, "embeddings").filter("label < 9").groupBy("label").agg(mean.alias("centre"))
    named = named.select(F.col("label").alias("position"), F.format_string("category_%d", "label").alias("name"), "centre")
    schema = spark.read.parquet(f"{d}/embeddings.parquet").schema
    v = F.col("vec_id")
    rows = streams.read_records(spark, f"{d}/embeddings.parquet*", schema).select(F.format_string("/lib/%02d.mp4", v % 37).alias("source_file"), "embedding")
    streams.live_categories(rows, named, F.round(V.cosine(F.col("embedding"), F.col("centre")), 9), f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return streams.stored_categories(spark, f"{home}/out").select("path", "category")


QUERIES = {f.__name__: f for f in (a14_semantic_index, a14_built_index, a15_enrichment_topk, a17_fused_search, a17_multimodal, a18_visual_only, p7_vector_from_field, i6_index_build, i5_vector_artifact, i7_modality_jobs, s7_artifact_records, s8_index_records, j1_artifacts_of_runs, j2_versions_with_definitions, j12_missing_sources, s3_register, s10_remove_and_clear, s11_categories, f9_category, u4_owned_files, i3_dead_letters, p22_fold, a23_spaced_frames, t2_first_seen, t2_first_events, t3_closed_windows, t4_progress, t5_live_categories)}

_SEGMENTS = """segments AS (SELECT *, ['scene_caption', 'ocr', 'transcript'][vec_id % 3 + 1] AS modality FROM chunks WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 3)"""



def _multimodal_sql() -> str:
    """Lists with their weights in the order in which they are merged; a moment is folded into the first one of its source that it overlaps by a fifth."""
    fields = "o INT, rank BIGINT, ga DOUBLE, gb DOUBLE, a DOUBLE, b DOUBLE, rrf DOUBLE, priority DOUBLE, modality VARCHAR, evidence VARCHAR, told DOUBLE, s0 DOUBLE, s1 DOUBLE, s2 DOUBLE, s3 DOUBLE, s4 DOUBLE"
    first, better = "priority > c.priority", "told > c.told AND evidence IS NOT NULL"
    own = ", ".join(f"CASE WHEN o = {k} THEN score END AS s{k}" for k in range(5))
    kept = ", ".join(f"'s{k}': greatest(c.s{k}, s{k})" for k in range(5))
    new = ", ".join(f"'s{k}': s{k}" for k in range(5))
    named = ", ".join(f"round(s{k}, 6) AS {x}_score" for k, x in enumerate(("visual", *MODALITIES, "exact")))
    return f"""WITH RECURSIVE {CHUNKS}, {ASKED}, n AS (SELECT printf('/lib/%02d.mp4', n_nationkey) AS source_file FROM nation),
c AS (SELECT *, 'label l' || label || ' part p' || (vec_id % 10) AS text, ['scene_caption', 'ocr', 'transcript'][vec_id % 3 + 1] AS modality FROM chunks WHERE source_file IN (SELECT source_file FROM n)),
l AS (SELECT query_id, 0 AS o, 0.40::DOUBLE AS weight, id, source_file, start_time, end_time, 'visual' AS modality, NULL AS text, round(list_cosine_similarity(v, q), 9) AS score FROM c, asked
  UNION ALL SELECT query_id, vec_id % 3 + 1, [0.25::DOUBLE, 0.15, 0.20][vec_id % 3 + 1], id, source_file, start_time, end_time, modality, text, round(list_cosine_similarity(v, q), 9) FROM c, asked WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 3
  UNION ALL SELECT query_id, 4, 0.75::DOUBLE, id, source_file, start_time, end_time, modality, text, 1.0::DOUBLE FROM c, asked WHERE label = q_label AND vec_id % 10 = query_id // 20 % 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, o ORDER BY score DESC, CASE WHEN o < 4 THEN source_file END, CASE WHEN o < 4 THEN start_time END, id) AS rank FROM l),
h AS (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id, source_file ORDER BY o, rank) AS n, o, rank, start_time AS a, end_time AS b, weight / (60 + rank) AS rrf, CASE WHEN o = 4 THEN 1 ELSE weight * score END::DOUBLE AS priority,
  modality, text AS evidence, CASE o WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE greatest(score, 0) END::DOUBLE AS told, {own} FROM r WHERE rank <= 40),
w AS (SELECT DISTINCT query_id, source_file, 0::BIGINT AS n, []::STRUCT({fields})[] AS found FROM h
  UNION ALL SELECT query_id, source_file, n, CASE WHEN place = 0 THEN list_append(found, {{'o': o, 'rank': rank, 'ga': a, 'gb': b, 'a': a, 'b': b, 'rrf': rrf, 'priority': priority, 'modality': modality, 'evidence': evidence, 'told': told, {new}}})
    ELSE list_transform(found, lambda c, i: CASE WHEN i <> place THEN c ELSE {{'o': c.o, 'rank': c.rank, 'ga': least(c.ga, a), 'gb': greatest(c.gb, b), 'a': CASE WHEN {first} THEN a ELSE c.a END, 'b': CASE WHEN {first} THEN b ELSE c.b END,
      'rrf': c.rrf + rrf, 'priority': greatest(c.priority, priority), 'modality': CASE WHEN {first} THEN modality ELSE c.modality END, 'evidence': CASE WHEN {better} THEN evidence ELSE c.evidence END,
      'told': CASE WHEN {better} THEN told ELSE c.told END, {kept}}} END) END
  FROM (SELECT h.*, w.found, coalesce(list_position(list_transform(w.found, lambda c: h.o > 0 AND greatest(least(c.gb, h.b) - greatest(c.ga, h.a), 0) / greatest(least(c.gb - c.ga, h.b - h.a), 0.001) >= 0.2), true), 0) AS place
    FROM w JOIN h ON h.query_id = w.query_id AND h.source_file = w.source_file AND h.n = w.n + 1)),
f AS (SELECT query_id, source_file, unnest(found, max_depth := 2) FROM w QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY n DESC) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, o, rank, source_file, a)::INT AS place FROM f)
SELECT query_id, place AS rank, source_file, a AS start_time, b AS end_time, round(least(greatest(rrf * 61, 0), 1), 6) AS score, modality AS primary_modality, evidence, {named} FROM best WHERE place <= 5"""


SQL = {
    "a14_semantic_index": f"""WITH {RECORDS}, {ASKED}, s AS (SELECT query_id, record_id, start_ms, round(list_cosine_similarity(e.embedding::DOUBLE[], q), 9) AS score
  FROM records JOIN embeddings e ON e.vec_id = record_id, asked WHERE k >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, start_ms, record_id)::INT AS rank FROM s)
SELECT query_id, rank, record_id, start_ms, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "a14_built_index": f"""WITH {ASKED}, s AS (SELECT query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q), 9) AS score FROM embeddings e, asked WHERE label >= 3),
r AS (SELECT query_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC) <= 5)
SELECT query_id, count(*)::BIGINT AS n, max(score) AS best, min(score) AS fifth, round(sum(score), 6) AS "all" FROM r GROUP BY query_id""",
    "a15_enrichment_topk": f"""WITH {CHUNKS}, {ASKED}, {_SEGMENTS}, s AS (SELECT query_id, modality, id, source_file, start_time, round(list_cosine_similarity(v, q), 9) AS score
  FROM segments, asked WHERE source_file IN (SELECT printf('/lib/%02d.mp4', n_nationkey) FROM nation)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, source_file, start_time, id)::INT AS rank FROM s)
SELECT query_id, modality, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "a17_fused_search": f"""WITH {CHUNKS}, {ASKED}, {_SEGMENTS}, s AS (
  SELECT query_id, id, 0.40 AS w, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(v, q), 9) DESC, source_file, start_time, id) AS rank FROM chunks, asked
  UNION ALL SELECT query_id, id, CASE modality WHEN 'scene_caption' THEN 0.25 WHEN 'ocr' THEN 0.15 ELSE 0.20 END,
    row_number() OVER (PARTITION BY query_id, modality ORDER BY round(list_cosine_similarity(v, q), 9) DESC, source_file, start_time, id) FROM segments, asked),
f AS (SELECT query_id, id, sum(w::DOUBLE / (60 + rank)) AS rrf FROM s WHERE rank <= 40 GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id)::INT AS rank FROM f)
SELECT query_id, rank, id, round(least(rrf * 61, 1), 6) AS score FROM r WHERE rank <= 5""",
    "a17_multimodal": _multimodal_sql(),
    "a18_visual_only": f"""WITH {CHUNKS}, {ASKED}, r AS (SELECT query_id, source_file, start_time, end_time, round(list_dot_product(v, q), 9) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(v, q), 9) DESC, source_file, start_time, id)::INT AS rank FROM chunks, asked)
SELECT query_id, rank, source_file, start_time, end_time, round(score, 6) AS score, 'visual' AS primary_modality FROM r WHERE rank <= 5""",
    "p7_vector_from_field": """SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last,
  round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings""",
    "i6_index_build": f"""WITH {RECORDS} SELECT 'events' AS name, 1 AS version, count(*)::BIGINT AS records, count(*)::BIGINT AS vectors, 'ready' AS status,
  count(DISTINCT concat_ws(chr(10), 'type: ' || type, 'tags: ' || array_to_string(tags, ', '), 'detail.kind: ' || kind))::BIGINT AS texts, 'type,tags,detail.kind' AS field_name FROM records""",
    "i5_vector_artifact": """WITH o AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS d FROM orders), n AS (SELECT *, greatest(1, ceil((d - 5000) / 25000.0))::BIGINT AS spans FROM o)
SELECT 'media_' || o_orderkey AS media_id, least(4, spans)::BIGINT AS n, (CASE WHEN spans <= 4 THEN d ELSE 105000 END)::BIGINT AS last_ms, 8 AS dimension FROM n""",
    "i7_modality_jobs": """WITH r AS (SELECT DISTINCT o_custkey AS c, CASE WHEN o_custkey % 2 = 0 THEN 'ocr' ELSE 'transcript' END AS m FROM orders WHERE o_orderpriority LIKE '1%')
SELECT c_custkey AS media_id, modality, 'nightly:' || modality AS key, r.c IS NOT NULL AS reused
FROM (SELECT c_custkey, unnest(['scene_caption', 'ocr', 'transcript']) AS modality FROM customer) LEFT JOIN r ON r.c = c_custkey AND r.m = modality""",
    "s7_artifact_records": """SELECT l_orderkey AS artifact_id, l_partkey AS start_ms, l_linenumber AS segment_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber)::INT AS place
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "s8_index_records": f"""WITH {RECORDS} SELECT media_id AS index_version_id, start_ms, record_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, record_id)::INT AS place FROM records WHERE media_id % 2 = 0""",
    "j1_artifacts_of_runs": """SELECT l_orderkey * 8 + l_linenumber AS artifact_id, o_custkey AS run_id, o_orderpriority AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""",
    "j2_versions_with_definitions": "SELECT o_orderkey AS version_id, o_custkey AS definition_id, c_mktsegment AS artifact_type FROM orders JOIN customer ON o_custkey = c_custkey",
    "j12_missing_sources": f"WITH {CHUNKS} SELECT id, source_file FROM chunks WHERE source_file NOT IN (SELECT printf('/lib/%02d.mp4', n_nationkey) FROM nation)",
    "s3_register": """WITH f AS (SELECT printf('/in/%08d.mp4', doc_id) AS uri, sha256(coalesce(text, '')) AS h FROM documents), g AS (SELECT min(uri) AS uri, h FROM f GROUP BY h)
SELECT 'media_' || substr(h, 1, 24) AS id, uri, h AS content_hash, 'video/mp4' AS mime_type FROM g WHERE h NOT IN (SELECT sha256(coalesce(html, '')) FROM pages)""",
    "s10_remove_and_clear": """WITH u AS (SELECT count(*) FILTER (role = 'user') AS removed, count(*) FILTER (role IS DISTINCT FROM 'user') AS cleared FROM conversations)
SELECT role, count(*)::BIGINT AS n, removed::BIGINT AS removed, cleared::BIGINT AS cleared, 0::BIGINT AS left FROM conversations, u WHERE role IS DISTINCT FROM 'user' GROUP BY ALL""",
    "s11_categories": "SELECT printf('/in/%08d', doc_id) AS path, lang AS category FROM documents",
    "f9_category": "SELECT 'one' AS kind, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'all', c_custkey FROM customer",
    "u4_owned_files": """SELECT printf('/lib/r%d/n%d/c%d.mp4', n_regionkey, n_nationkey, c_custkey) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 OR n_regionkey = 1""",
    "i3_dead_letters": """SELECT o_orderkey AS id, o_custkey AS source_file, CASE WHEN o_orderpriority LIKE '1%' THEN 'new' ELSE 'old' END AS error,
  CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 1 END AS attempts, CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END AS last_attempt
FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') AND o_custkey % 4 <> 0""",
    "p22_fold": "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents",
    "a23_spaced_frames": """WITH o AS (SELECT o_orderkey, trunc(o_totalprice)::INT % 700 AS n, (o_custkey % 5 + 20)::DOUBLE AS fps, (o_orderkey % 9)::DOUBLE AS s FROM orders),
f AS (SELECT *, least(n - 1, trunc(s * fps)::INT) AS a FROM o), g AS (SELECT *, least(n - 1, greatest(a, trunc((s + 10) * fps)::INT - 1)) AS b FROM f), h AS (SELECT *, least(8, b - a + 1) AS c FROM g)
SELECT o_orderkey, CASE WHEN n > 0 THEN array_to_string(list_transform(range(0, c), lambda i: trunc(a + i * ((b - a)::DOUBLE / greatest(c - 1, 1)))::INT), ' ') END AS frames,
  CASE WHEN n > 0 THEN least(500, n) END AS whole FROM h""",
    "t2_first_seen": "SELECT DISTINCT user_id FROM events",
    "t2_first_events": "SELECT user_id, min(epoch_us(ts)) AS us, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "t3_closed_windows": """WITH b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
e AS (SELECT epoch_us(ts) AS us, event_type, value, least((epoch_us(ts) - low) * 4 // (high - low + 1) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END, 3) AS part FROM events, b),
m AS (SELECT p AS part, max(us) // 1000 AS latest FROM e, (SELECT unnest([0, 1, 2, 3]) AS p) WHERE part < p GROUP BY p),
w AS (SELECT e.*, (us // 18000000000 - i) * 18000000 AS start_ms FROM e, (SELECT unnest([0, 1]) AS i) WHERE us < ((us // 18000000000 - i) * 18000000 + 21600000) * 1000),
l AS (SELECT w.*, coalesce(start_ms + 21600000 <= latest - 3600000, false) AS late FROM w LEFT JOIN m ON m.part = w.part)
SELECT start_ms * 1000 AS window_start, event_type, (count_if(NOT late) > 0)::BIGINT AS times, count_if(NOT late)::BIGINT AS n, count_if(late)::BIGINT AS late,
  round(coalesce(sum(value) FILTER (NOT late), 0), 6) AS total FROM l GROUP BY start_ms, event_type""",
    "t4_progress": "SELECT count(*)::BIGINT AS rows, true AS any FROM documents",
    "t5_live_categories": f"""WITH {CHUNKS}, m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM chunks WHERE label < 9) GROUP BY label, i) GROUP BY label),
s AS (SELECT source_file, m.label AS position, max(round(list_cosine_similarity(v, c), 9)) AS score FROM chunks, m GROUP BY source_file, m.label)
SELECT source_file AS path, 'category_' || position AS category FROM s QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY score DESC, position) = 1""",
}
