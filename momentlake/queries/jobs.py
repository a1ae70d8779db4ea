"""Index jobs over the driver's tables: documents as media, 60 ms a character, some spans still, some that cannot be embedded."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions.moments import chunk_id
from momentlake.operators import anomalies, stats
from momentlake.operators import records as R
from momentlake.plans import enrichment, index_job, ingest
from momentlake.queries._tables import r6, table
from momentlake.sources import manifests
from momentlake.sources.index_store import IndexStore
from momentlake.sources.shared import shared_path
from momentlake.sources.snapshots import SnapshotTable
from momentlake.streaming import ingest as streams

CONFIG = index_job.IndexConfig(dimension=4, backend="table", model="small")


def _source(doc: Column) -> Column:
    return F.format_string("/in/%06d.mp4", doc)


def _media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(_source(F.col("doc_id")).alias("source_file"), (F.length("text") * 60).cast("long").alias("duration_ms"), F.col("doc_id").cast("string").alias("payload"), "doc_id")


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _still(media: DataFrame) -> DataFrame:
    """id of still spans: each span has two frames of twelve equal bytes."""
    spans = index_job.expected_spans(media, CONFIG).select(F.split("payload", ":")[0].cast("long").alias("doc"), "segment")
    low = (F.col("doc") * 7 + F.col("segment") * 3) % 60
    high = low + (F.col("segment") * 5 + F.col("doc")) % 40
    each = spans.select((F.col("doc") * 1_000_000 + F.col("segment")).alias("span_id"), F.posexplode(F.array(low, high)).alias("frame_idx", "value"))
    still = anomalies.still_spans(each.select("span_id", "frame_idx", F.encode(F.repeat(F.chr("value"), F.lit(12)), "UTF-8").alias("rgb")))
    doc, segment = F.floor(F.col("span_id") / 1_000_000), F.col("span_id") % 1_000_000
    return still.select(chunk_id(_source(doc), segment * 25.0).alias("id"))


def _embedder(busy: bool = True):  # noqa: ANN202
    def embed(payloads: list[str]) -> np.ndarray:
        out = []
        for doc, segment in (map(int, p.split(":")) for p in payloads):
            if doc % 11 == 3 and segment % 4 == 1:
                raise ValueError("could not decode")
            if busy and doc % 13 == 5 and segment % 3 == 2:
                raise RuntimeError("busy")
            out.append([doc % 7 + 1, segment % 5, 1, 0])
        return np.array(out, float)

    return embed


def _three_runs(spark: SparkSession, d: str) -> tuple[IndexStore, list[index_job.Report]]:
    """A first run, the same again, and one that tries failed spans again with an embedder that is not busy any more."""
    store, media = IndexStore(spark, shared_path(spark, "index")), _staged(_media(spark, d), "media")  # read in each run
    still, again = _staged(_still(media), "still"), index_job.IndexConfig(**{**CONFIG.__dict__, "retry_failed": True})
    runs = ((CONFIG, _embedder()), (CONFIG, _embedder()), (again, _embedder(busy=False)))
    return store, [index_job.run_index(media, store, embedder, config, still, now) for now, (config, embedder) in enumerate(runs, 1)]


def i1_index_job(spark: SparkSession, d: str) -> DataFrame:
    """What each run's ledger says of each source."""
    store, reports = _three_runs(spark, d)
    parts = [store.ledger(r.version).withColumn("run", F.lit(r.version)) for r in reports]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("run", "source_file", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.max("error").alias("error"))


def i1_index_report(spark: SparkSession, d: str) -> DataFrame:
    """The reports that the jobs gave, and the same counts by the ledgers, with the letters and the store's chunks."""
    store, reports = _three_runs(spark, d)
    out = []
    for r in reports:
        by_ledger = R.run_report(store.ledger(r.version)).select(F.lit(r.version).alias("run"), *(F.col(c).alias(c) for c in ("files", "chunks_new", "chunks_skipped", "chunks_still", "chunks_failed", "chunks")))
        told = {"files": r.files, "chunks_new": r.chunks_new, "chunks_skipped": r.chunks_skipped, "chunks_still": r.chunks_still, "chunks_failed": r.chunks_failed, "chunks": r.chunks}
        agree = reduce(lambda a, b: a & b, (F.col(c) == n for c, n in told.items()))
        letters = store.letters(r.version).agg(F.count("*").alias("letters"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("letter_attempts"))
        stored = store.chunks(r.version).agg(F.count("*").alias("stored"), r6(F.coalesce(F.sum(F.col("embedding")[0]), F.lit(0.0))).alias("weight"))
        out.append(by_ledger.withColumns({"agree": agree, "files_indexed": F.lit(r.files_indexed).cast("long")}).crossJoin(letters).crossJoin(stored))  # a row each
    return reduce(DataFrame.unionByName, out)


def _in_files(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """Media as a stream of n batches: those whose doc_id has remainder 0, 1, ... by n."""
    path, media = shared_path(spark, "batches"), _staged(_media(spark, d), "media")
    files = streams.write_batches([media.filter(F.pmod("doc_id", F.lit(n)) == k) for k in range(n)], path)
    return streams.read_records(spark, path, media.schema, files_per_trigger=files)


def i8_pinned_versions(spark: SparkSession, d: str) -> DataFrame:
    """Readers of each version of an index that was built in batches see its whole batches, whatever came later."""
    store, stream = IndexStore(spark, shared_path(spark, "index")), _in_files(spark, d)
    index_job.run_index_stream(stream, store, _embedder(), CONFIG, shared_path(spark, "checkpoint"))
    parts = [store.chunks(v).agg(F.count("*").alias("chunks"), F.count_distinct("source_file").alias("sources"), r6(F.sum(F.col("embedding")[0])).alias("weight")).withColumn("version", F.lit(v)) for v in range(1, store.version() + 1)]
    return reduce(DataFrame.unionByName, parts)


def i9_resume(spark: SparkSession, d: str) -> DataFrame:
    """An index job that is cancelled before its third batch and then goes on: chunks and failures of each source, none twice."""
    store, stream, checkpoint = IndexStore(spark, shared_path(spark, "index")), _in_files(spark, d), shared_path(spark, "checkpoint")
    first = index_job.run_index_stream(stream, store, _embedder(), CONFIG, checkpoint, should_cancel=lambda: store.version() >= 2)
    second = index_job.run_index_stream(stream, store, _embedder(), CONFIG, checkpoint)
    ledgers = reduce(DataFrame.unionByName, [store.ledger(v) for v in range(1, store.version() + 1)])
    asked = ledgers.groupBy("source_file").agg(F.count("*").alias("spans"), F.count_distinct("id").alias("ids"), F.count_if(F.col("status") == "failed").alias("failed"))
    chunks = store.chunks().groupBy("source_file").agg(F.count("*").alias("chunks"))
    joined = asked.join(chunks, "source_file", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("long"))
    return joined.withColumns({"first": F.lit(len(first.reports)), "cancelled": F.lit(first.cancelled), "second": F.lit(len(second.reports)), "finished": F.lit(not second.cancelled)})


def s12_enrichment_report(spark: SparkSession, d: str) -> DataFrame:
    """Turns as records, some without text: what two imports, of which the second repeats the first and adds to it, report and store."""
    c = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 5 == 3, " \n").otherwise(F.col("text"))
    modality = F.when(F.col("role") == "user", "ocr").when(F.col("role") == "assistant", "transcript").otherwise("other")
    rows = c.select(F.format_string("r%d_%d", "conv_id", "turn").alias("id"), F.format_string("/in/%d.mp4", "conv_id").alias("source_file"), modality.alias("modality"), F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1.0).alias("end_time"), F.parse_json(F.to_json(F.struct(text.alias("text")))).alias("data"), "conv_id")
    store = SnapshotTable(spark, shared_path(spark, "enriched"), spark.createDataFrame([], enrichment.SEGMENT).schema)
    one = enrichment.enrich(rows.filter("conv_id % 3 <> 0"), store, ingest.hashing_embedder(8), 8, "table", "hash")
    two = enrichment.enrich(rows, store, ingest.hashing_embedder(8), 8, "table", "hash")
    stored = store.read().groupBy("modality").agg(F.count("*").alias("stored"))
    told = {f"{name}_{c}": getattr(r, c) for name, r in (("first", one), ("second", two)) for c in ("seen", "indexed", "empty")}
    return stored.withColumns({k: F.lit(v).cast("long") for k, v in told.items()})


def g3_sketch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of three snapshots: merged counts of chunks and sources, and whether the sketch is within three standard errors of the true count."""
    rows = table(spark, d, "documents").select(_source(F.col("doc_id")).alias("source_file"), "doc_id")
    parts = [stats.snapshot_stats(rows.filter(F.pmod("doc_id", F.lit(3)) == k)) for k in range(3)]
    exact = rows.agg(F.count_distinct("source_file").alias("exact"))
    both = stats.merged(reduce(DataFrame.unionByName, parts)).crossJoin(exact)  # a row each
    return both.select("chunks", "exact", (F.abs(F.col("sources") - F.col("exact")) <= 3 * stats.ERROR * F.col("exact")).alias("within"))


def g3_sources(spark: SparkSession, d: str) -> DataFrame:
    return stats.sources(table(spark, d, "documents").select(F.col("source").alias("source_file")))


def a20_activate(spark: SparkSession, d: str) -> DataFrame:
    """An alias that is set to the first ready version, to the last one and back: its log, and what it stands for."""
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("index_version_id"), F.lit("orders").alias("name"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("building").alias("status"))
    low, high = versions.filter("status = 'ready'").agg(F.min("version"), F.max("version")).first()
    aliases = spark.createDataFrame([], "alias string, index_version_id long, updated_at long")
    for at, version in enumerate((low, high, low), 1):
        aliases = R.activate(aliases, versions, "live", version, at)
    resolved = R.resolve(versions, aliases, spark.createDataFrame([("live",)], "name string"))
    return aliases.join(resolved.select(F.col("name").alias("alias"), F.col("index_version_id").alias("now")), "alias")


def s5_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Events as analyzer manifests, a file for each of 97 groups of users, read back as the rows that an import takes."""
    e, path = table(spark, d, "events"), shared_path(spark, "manifests")
    start = (F.unix_micros("ts") / 1000).cast("long")
    record = F.struct(F.format_string("segment_%d", "event_id").alias("segment_id"), start.alias("start_ms"), (start + 1000).alias("end_ms"), F.to_json(F.struct("event_type", "user_id")).alias("data"), F.when(F.col("event_id") % 2 == 0, "{broken").otherwise('{"v": 1}').alias("metadata"))
    groups = e.groupBy(F.pmod("user_id", F.lit(97)).alias("m")).agg(F.collect_list(record).alias("records"))  # a manifest is one document
    manifest = F.struct(F.format_string("analyzer_%d", "m").alias("name"), F.lit("event").alias("artifact_type"), F.lit(1).alias("schema_version"), "records")
    groups.select("m", F.to_json(F.array(manifest)).alias("value")).repartition("m").write.partitionBy("m").text(path)
    rows = manifests.read_manifests(spark, f"{path}/*", "media_1", "nightly")
    return rows.select("name", "artifact_type", "segment_id", "start_ms", "end_ms", F.try_variant_get("data", "$.event_type", "string").alias("event_type"), F.try_variant_get("metadata", "$.v", "int").alias("v"))


def i10_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Which backends and models may write to stores that hold the vectors of chunks."""
    stored = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "table").otherwise("other").alias("backend"), F.lit("unit64").alias("model"))
    one, none, out = stored.filter("backend = 'table'"), stored.limit(0), []
    for store, rows in (("one", one), ("both", stored), ("none", none)):
        for backend, model in (("table", "unit64"), ("other", "unit64"), ("table", "large")):
            try:
                ingest.check_compatible(rows, backend, model)
                out.append((store, backend, model, True))
            except ValueError:
                out.append((store, backend, model, False))
    return spark.createDataFrame(out, "store string, backend string, model string, ok boolean")


QUERIES = {f.__name__: f for f in (i1_index_job, i1_index_report, i8_pinned_versions, i9_resume, s12_enrichment_report, g3_sketch_stats, g3_sources, a20_activate, s5_manifests, i10_compatible)}

_SPANS = """m AS (SELECT doc_id, printf('/in/%06d.mp4', doc_id) AS source_file, length(text) * 60 AS d FROM documents),
spans AS (SELECT doc_id, source_file, coalesce(d > 0, false) AS readable, unnest(range(0, CASE WHEN d > 0 THEN greatest(1, ceil((d - 5000) / 25000.0))::BIGINT ELSE 1 END)) AS segment FROM m),
told AS (SELECT *, (doc_id * 7 + segment * 3) % 60 AS low, (segment * 5 + doc_id) % 40 AS apart, doc_id % 11 = 3 AND segment % 4 = 1 AS broken, doc_id % 13 = 5 AND segment % 3 = 2 AS busy,
  (doc_id % 7 + 1) / sqrt((doc_id % 7 + 1)::DOUBLE ** 2 + (segment % 5)::DOUBLE ** 2 + 1) AS w FROM spans)"""
_LEDGERS = f"""{_SPANS}, one AS (SELECT *, CASE WHEN NOT readable THEN 'failed' WHEN apart / 255.0 < 0.03 AND low + apart > 0 THEN 'still' WHEN broken OR busy THEN 'failed' ELSE 'new' END AS s FROM told),
ledger AS (SELECT 1 AS run, *, s AS status, CASE s WHEN 'new' THEN 1 WHEN 'failed' THEN CASE WHEN readable AND NOT broken THEN 3 ELSE 1 END END AS attempts FROM one
  UNION ALL SELECT 2, *, CASE s WHEN 'still' THEN s ELSE 'skipped' END, NULL FROM one
  UNION ALL SELECT 3, *, CASE WHEN s = 'new' THEN 'skipped' WHEN s = 'failed' AND readable AND NOT broken THEN 'new' ELSE s END, CASE WHEN s = 'failed' THEN 1 END FROM one)"""

SQL = {
    "i1_index_job": f"""WITH {_LEDGERS} SELECT run, source_file, status, count(*)::BIGINT AS n, coalesce(sum(attempts), 0)::BIGINT AS attempts,
  max(CASE WHEN status = 'failed' THEN CASE WHEN NOT readable THEN 'file not found' WHEN broken THEN 'could not decode' ELSE 'busy' END END) AS error FROM ledger GROUP BY run, source_file, status""",
    "i1_index_report": f"""WITH {_LEDGERS}, c AS (SELECT run, count(DISTINCT source_file)::BIGINT AS files, count_if(status = 'new')::BIGINT AS chunks_new, count_if(status = 'skipped')::BIGINT AS chunks_skipped,
  count_if(status = 'still')::BIGINT AS chunks_still, count_if(status = 'failed')::BIGINT AS chunks_failed, count(*)::BIGINT AS chunks, (count(DISTINCT source_file) FILTER (status = 'new'))::BIGINT AS files_indexed FROM ledger GROUP BY run),
f AS (SELECT run, count_if(l.failed)::BIGINT AS letters, coalesce(sum(l.tries) FILTER (l.failed), 0)::BIGINT AS letter_attempts, count_if(l.stored)::BIGINT AS stored, round(coalesce(sum(w) FILTER (l.stored), 0), 6) AS weight
  FROM (SELECT r.run, w, s = 'failed' AND (r.run < 3 OR NOT readable OR broken) AS failed, CASE WHEN readable AND NOT broken THEN 3 ELSE 1 END AS tries, s = 'new' OR (r.run = 3 AND s = 'failed' AND readable AND NOT broken) AS stored
        FROM one, (SELECT unnest([1, 2, 3]) AS run) r) l GROUP BY run)
SELECT c.*, true AS agree, letters, letter_attempts, stored, weight FROM c JOIN f ON f.run = c.run""",
    "i8_pinned_versions": f"""WITH {_SPANS} SELECT v::INT AS version, count(*)::BIGINT AS chunks, count(DISTINCT source_file)::BIGINT AS sources, round(sum(w), 6) AS weight
FROM told, (SELECT unnest([1, 2, 3, 4]) AS v) WHERE readable AND NOT broken AND NOT busy AND doc_id % 4 < v GROUP BY v""",
    "i9_resume": f"""WITH {_SPANS} SELECT source_file, count(*)::BIGINT AS spans, count(*)::BIGINT AS ids, count_if(NOT readable OR broken OR busy)::BIGINT AS failed, count_if(readable AND NOT broken AND NOT busy)::BIGINT AS chunks,
  2 AS first, true AS cancelled, 2 AS second, true AS finished FROM told GROUP BY source_file""",
    "s12_enrichment_report": """WITH r AS (SELECT conv_id, CASE role WHEN 'user' THEN 'ocr' WHEN 'assistant' THEN 'transcript' ELSE 'other' END AS modality, turn % 5 <> 3 AND regexp_matches(text, '\\S') AND role IN ('user', 'assistant') AS told FROM conversations),
n AS (SELECT count_if(conv_id % 3 <> 0)::BIGINT AS first_seen, count_if(conv_id % 3 <> 0 AND told)::BIGINT AS first_indexed, count_if(conv_id % 3 <> 0 AND NOT told)::BIGINT AS first_empty,
  count(*)::BIGINT AS second_seen, count_if(conv_id % 3 = 0 AND told)::BIGINT AS second_indexed, count_if(NOT told)::BIGINT AS second_empty FROM r)
SELECT modality, count(*)::BIGINT AS stored, first_seen, first_indexed, first_empty, second_seen, second_indexed, second_empty FROM r, n WHERE told GROUP BY ALL""",
    "g3_sketch_stats": "SELECT count(*)::BIGINT AS chunks, count(DISTINCT doc_id)::BIGINT AS exact, true AS within FROM documents",
    "g3_sources": "SELECT source AS source_file, count(*)::BIGINT AS chunks FROM documents GROUP BY source",
    "a20_activate": """WITH v AS (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderstatus = 'F')
SELECT 'live' AS alias, CASE WHEN turn = 2 THEN high ELSE low END AS index_version_id, turn AS updated_at, low AS now FROM v, (SELECT unnest([1::BIGINT, 2, 3]) AS turn)""",
    "s5_manifests": """SELECT 'analyzer_' || (user_id % 97) AS name, 'event' AS artifact_type, 'segment_' || event_id AS segment_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1000 AS end_ms, event_type, CASE WHEN event_id % 2 = 1 THEN 1 END AS v FROM events""",
    "i10_compatible": """WITH s AS (SELECT DISTINCT CASE WHEN vec_id % 2 = 0 THEN 'table' ELSE 'other' END AS b, 'unit64' AS m FROM embeddings), n AS (SELECT unnest(['one', 'both', 'none']) AS store),
a AS (SELECT * FROM (VALUES ('table', 'unit64'), ('other', 'unit64'), ('table', 'large')) AS a(backend, model))
SELECT store, backend, model, NOT EXISTS (SELECT 1 FROM s WHERE (store = 'both' OR (store = 'one' AND b = 'table')) AND (b <> backend OR m <> model)) AS ok FROM n, a""",
}
