"""JSON records: filters, sorts, facets, artifacts, versions, lineage, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import sql
from momentlake.functions import text as T
from momentlake.functions.moments import chunk_id
from momentlake.operators import records as R
from momentlake.operators import structured, typed_index
from momentlake.operators.structured import Query
from momentlake.plans import artifacts
from momentlake.queries._tables import CHUNKS, RECORDS, chunks, event_records, table
from momentlake.sources import snapshots
from momentlake.sources.shared import shared_path


def _matching(*filters: tuple[str, str, object]):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = event_records(spark, d)
        for path, op, value in filters:
            rows = rows.filter(structured.predicate(F.col("data"), path, op, value))
        return rows.select("record_id", "start_ms")

    return run


def a12_sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred records by k descending (missing first), then type ascending."""
    q = Query(sort=(("k", "desc"), ("type", "asc")))
    return structured.run_query(event_records(spark, d), q, {"k", "type"}).select("record_id", "start_ms")


def _typed(spark: SparkSession, d: str) -> tuple[typed_index.TypedIndex, DataFrame]:
    """Events as an index version, and as one of all their halves, with typed columns; the rows of the first."""
    index = typed_index.TypedIndex(spark, shared_path(spark, "typed"), ["type", "k", "tags", "detail.kind", "detail.value"])
    rows = event_records(spark, d)
    half = rows.filter("record_id % 2 = 0").withColumn("index_version_id", F.lit("half"))
    index.write(rows.withColumn("index_version_id", F.lit("all")).unionByName(half))
    return index, index.read("all", "long")


def f_typed_filters(spark: SparkSession, d: str) -> DataFrame:
    """Every operator on typed columns: which records each of six filters keeps."""
    index, rows = _typed(spark, d)
    asked = {
        "range": (("k", "gt", 20), ("k", "lte", 60), ("type", "lt", "purchase")), "eq": (("type", "eq", "error"),), "not_eq": (("k", "not_eq", 5),),
        "in": (("k", "in", [1, 2, 3, "4"]),), "contains": (("tags", "contains", "u3"), ("type", "contains", "i")), "missing": (("detail.kind", "gte", "a"), ("detail.value", "lt", 50.5)),
    }
    parts = [index.filtered(rows, f).select(F.lit(name).alias("filter"), "record_id", "start_ms") for name, f in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def a12_typed_page(spark: SparkSession, d: str) -> DataFrame:
    index, rows = _typed(spark, d)
    return index.query(rows, Query((("type", "not_eq", "view"),), (("k", "desc"), ("type", "asc")))).select("record_id", "start_ms")


def g1_typed_facet(spark: SparkSession, d: str) -> DataFrame:
    index, rows = _typed(spark, d)
    return index.facet(rows, "tags", (("k", "gte", 10),))


def g1_facet(spark: SparkSession, d: str) -> DataFrame:
    return structured.facet(event_records(spark, d), "tags", (("k", "gte", 10),))


def g1_facet_nested(spark: SparkSession, d: str) -> DataFrame:
    return structured.facet(event_records(spark, d), "detail.kind")


def p9_semantic_text(spark: SparkSession, d: str) -> DataFrame:
    rows = event_records(spark, d).withColumn("id", F.col("record_id")).drop("record_id")
    built = artifacts.build_index(rows, artifacts.IndexDefinition("events", "event", semantic_fields=("type", "tags", "detail.kind"), filter_fields=("k",)), 1)
    return built.select(F.col("artifact_record_id").alias("record_id"), "media_id", "semantic_text", F.substring("index_version_id", 1, 6).alias("version_prefix"))


def p10_searchable_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    data = F.parse_json(F.to_json(F.struct(F.col("text").alias("description"), F.lit("street.").alias("setting"), F.col("text").alias("text"), F.array("role", F.lit(" ")).alias("activities"))))
    modality = F.when(F.col("role") == "user", "scene_caption").when(F.col("role") == "assistant", "transcript").otherwise("other")
    return c.select("conv_id", "turn", F.md5(F.encode(T.searchable_text(modality, data), "UTF-8")).alias("text_md5"))


def p24_rescued_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers in code fences, every third one broken."""
    fence = F.concat(F.lit("```json\nHere: "), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props")), F.lit("\n```"))
    v = T.rescued_json(fence)
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.parse_fallback", "boolean"), F.lit(False)).alias("fallback"))


def p11_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """Analyzer outputs: a run for each user, an analyzer for each type of event."""
    rows = event_records(spark, d)
    return rows.select(F.format_string("media_%d", "media_id").alias("media_id"), F.lit("nightly").alias("key"), F.col("event_type").alias("name"), F.col("event_type").alias("artifact_type"), F.format_string("segment_%06d", "record_id").alias("segment_id"), "start_ms", "end_ms", "data")


def i4_understand(spark: SparkSession, d: str) -> DataFrame:
    """Rows that an import adds: first time, and again."""
    outputs = _outputs(spark, d)
    first = artifacts.understand(outputs, spark.createDataFrame([], "media_id string, key string, request_hash string"))
    again = artifacts.understand(outputs, first.runs)
    parts = [x.select(F.lit(turn).alias("turn"), F.lit(name).alias("kind")) for turn, got in (("first", first), ("again", again)) for name, x in (("runs", got.runs), ("analyzers", got.analyzers), ("artifacts", got.artifacts), ("records", got.records), ("edges", got.edges))]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("turn", "kind").agg(F.count("*").alias("n"))


def g6_validate_versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as index versions of line items: the expected number of records is five each."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index_version_id"), F.col("l_quantity").alias("start_ms"), (F.col("l_quantity") + F.col("l_extendedprice") - 5000).alias("end_ms"))
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("index_version_id"), F.lit(5).alias("record_count"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("index_version_id"), "embedding")
    return artifacts.validate_version(li, expected, vectors)


def a19_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Customers as definitions, their orders as versions; aliases are set for the urgent ones."""
    o = table(spark, d, "orders")
    versions = o.select(F.col("o_orderkey").alias("index_version_id"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("building").alias("status"))
    aliases = o.filter("o_orderpriority like '1%'").select(F.col("o_custkey").cast("string").alias("alias"), F.col("o_orderkey").alias("index_version_id"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    return R.resolve(versions, aliases, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name")))


def g13_next_versions(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("version"))
    return R.next_versions(table(spark, d, "orders").select(F.col("o_orderkey").alias("name")), versions)


def j11_lineage(spark: SparkSession, d: str) -> DataFrame:
    """From regions over nations and customers to orders."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edges = table(spark, d, "nation").select(name("region", "n_regionkey").alias("parent_id"), name("nation", "n_nationkey").alias("child_id"))
    edges = edges.union(table(spark, d, "customer").select(name("nation", "c_nationkey"), name("customer", "c_custkey")))
    edges = edges.union(table(spark, d, "orders").select(name("customer", "o_custkey"), name("order", "o_orderkey")))
    reached = R.lineage(edges, table(spark, d, "region").select(name("region", "r_regionkey").alias("id")))
    return reached.groupBy("root", "depth").agg(F.count("*").alias("n"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    """Line items as chunks of their orders, with a status each."""
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "new").when(F.col("l_linenumber") > 3, "still").otherwise("skipped")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_file"), status.alias("status"))


def g14_progress(spark: SparkSession, d: str) -> DataFrame:
    return R.progress(_status(spark, d))


def g9_run_report(spark: SparkSession, d: str) -> DataFrame:
    return R.run_report(_status(spark, d))


def g8_timings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("spread"), F.round(F.sum("l_quantity"), 2).alias("total"))


def g3_store_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source_list"))


def g2_modality_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("role").alias("modality")).agg(F.count("*").alias("n"))


def s9_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders, upserted with the doubled prices of the urgent ones."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    new = o.filter("o_orderpriority like '1%'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return snapshots.upserted(o.filter("o_orderstatus = 'F'"), new).select("id", F.round("o_totalprice", 2).alias("price"))


def s12_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """Documents that come in by text: each text once, none that an old one (of source src0) has."""
    t = table(spark, d, "documents").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key"), "source")
    return snapshots.absent(t.filter("source = 'src0'"), t.filter("source <> 'src0'"), "key").select("doc_id", "key")


def u5_merge_categories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("category"), "c_acctbal")
    return R.merge_categories(t.filter("c_acctbal > 0").drop("c_acctbal"), t.filter("c_acctbal < 5000").select("path", F.lower("category").alias("category")))


def j9_apply_categories(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.lit("Unsorted").alias("category"))
    return R.apply_categories(pages, table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("category")))


def a24_distinct_moments(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_file"), F.col("l_quantity").alias("start_time"), (F.col("l_quantity") + F.col("l_discount")).alias("end_time"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rank"))
    return R.distinct_moments(li.groupBy("source_file", "start_time", "end_time").agg(F.min("rank").alias("rank"))).select("source_file", "rank")


def g4_architecture_stats(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("building").alias("status"))
    return R.table_counts({n: table(spark, d, n) for n in ("documents", "pages", "events", "embeddings")}, versions)


def p25_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as a result: its file, its medium's id (the chunk id at 0) and its span."""
    hits = chunks(spark, d)
    return R.descriptors(hits, chunk_id(F.col("source_file"), F.lit(0.0))).select("id", "file_name", "media_id", "span")


def u3_requested_sources(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nation").select(F.format_string("/lib/%02d.mp4", F.col("n_nationkey") * 2).alias("source_file"))
    return R.requested_sources(asked, chunks(spark, d))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The temporary SQL functions over whole tables: spans of orders, similarity of the halves of vectors."""
    sql.register(spark)
    table(spark, d, "orders").createOrReplaceTempView("momentlake_orders")
    table(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as v").createOrReplaceTempView("momentlake_vectors")
    return spark.sql("""
        SELECT 'order' AS kind, o_orderkey AS id, CAST(size(s) AS DOUBLE) AS x, CAST(element_at(s, -1).end_ms AS DOUBLE) AS y
        FROM (SELECT o_orderkey, segment_spans(CAST(round(o_totalprice) AS BIGINT), 30000L, 5000L) AS s FROM momentlake_orders)
        UNION ALL SELECT 'vector', vec_id, round(cosine_similarity(slice(v, 1, 32), slice(v, 33, 32)), 6), round(l2_normalize(slice(v, 1, 32))[0], 6) FROM momentlake_vectors""")


QUERIES = {
    "f1_eq": _matching(("type", "eq", "error")),
    "f2_not_eq": _matching(("k", "not_eq", 5)),
    "f3_in": _matching(("k", "in", [1, 2, 3, "4"])),
    "f4_range": _matching(("k", "gt", 20), ("k", "lte", 60), ("type", "lt", "purchase")),
    "f5_contains": _matching(("tags", "contains", "u3"), ("type", "contains", "i")),
    "f4_missing": _matching(("detail.kind", "gte", "a"), ("detail.value", "lt", 50.5)),
} | {f.__name__: f for f in (a12_sorted_page, a12_typed_page, f_typed_filters, g1_typed_facet, g1_facet, g1_facet_nested, p9_semantic_text, p10_searchable_text, p24_rescued_json, p11_content_hash, i4_understand, g6_validate_versions, a19_resolve, g13_next_versions, j11_lineage, g14_progress, g9_run_report, g8_timings, g3_store_stats, g2_modality_counts, s9_upsert, s12_insert_absent, u5_merge_categories, j9_apply_categories, a24_distinct_moments, g4_architecture_stats, p25_descriptors, u3_requested_sources, sql_functions)}

_STATUS = "s AS (SELECT l_orderkey AS source_file, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'new' WHEN l_linenumber > 3 THEN 'still' ELSE 'skipped' END AS status FROM lineitem)"


def _where(condition: str) -> str:
    return f"WITH {RECORDS} SELECT record_id, start_ms FROM records WHERE {condition}"


SQL = {
    "f1_eq": _where("type = 'error'"),
    "f2_not_eq": _where("k <> 5"),
    "f3_in": _where("k IN (1, 2, 3)"),
    "f4_range": _where("k > 20 AND k <= 60 AND type < 'purchase'"),
    "f5_contains": _where("list_contains(tags, 'u3') AND contains(type, 'i')"),
    "f4_missing": _where("kind >= 'a' AND value < 50.5"),
    "a12_sorted_page": f"WITH {RECORDS} SELECT record_id, start_ms FROM records ORDER BY k DESC NULLS FIRST, type, start_ms, record_id LIMIT 100",
    "f_typed_filters": f"""WITH {RECORDS}
SELECT 'range' AS filter, record_id, start_ms FROM records WHERE k > 20 AND k <= 60 AND type < 'purchase' UNION ALL SELECT 'eq', record_id, start_ms FROM records WHERE type = 'error'
UNION ALL SELECT 'not_eq', record_id, start_ms FROM records WHERE k <> 5 UNION ALL SELECT 'in', record_id, start_ms FROM records WHERE k IN (1, 2, 3)
UNION ALL SELECT 'contains', record_id, start_ms FROM records WHERE list_contains(tags, 'u3') AND contains(type, 'i')
UNION ALL SELECT 'missing', record_id, start_ms FROM records WHERE kind >= 'a' AND value < 50.5""",
    "a12_typed_page": f"WITH {RECORDS} SELECT record_id, start_ms FROM records WHERE type <> 'view' ORDER BY k DESC NULLS FIRST, type, start_ms, record_id LIMIT 100",
    "g1_typed_facet": f"""WITH {RECORDS} SELECT '"' || t || '"' AS value, count(*)::BIGINT AS count FROM (SELECT unnest(tags) AS t FROM records WHERE k >= 10) GROUP BY t""",
    "g1_facet": f"""WITH {RECORDS} SELECT '"' || t || '"' AS value, count(*)::BIGINT AS count FROM (SELECT unnest(tags) AS t FROM records WHERE k >= 10) GROUP BY t""",
    "g1_facet_nested": f"""WITH {RECORDS} SELECT '"' || kind || '"' AS value, count(*)::BIGINT AS count FROM records WHERE kind IS NOT NULL GROUP BY kind""",
    "p9_semantic_text": f"""WITH {RECORDS} SELECT record_id, media_id, concat_ws(chr(10), 'type: ' || type, 'tags: ' || array_to_string(tags, ', '), 'detail.kind: ' || kind) AS semantic_text, 'index_' AS version_prefix FROM records""",
    "p10_searchable_text": """SELECT conv_id, turn, md5(CASE role WHEN 'user' THEN concat_ws(' · ', nullif(regexp_replace(trim(text), '[.,;:!?]+$', ''), ''), 'street', role) WHEN 'assistant' THEN trim(text) ELSE '' END) AS text_md5 FROM conversations""",
    "p24_rescued_json": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k')::INT END AS k, event_id % 3 = 0 AS fallback FROM events",
    "p11_content_hash": "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS hash FROM documents",
    "i4_understand": """WITH u AS (SELECT count(DISTINCT user_id) AS runs, count(DISTINCT (user_id, event_type)) AS analyzers, count(*) AS records FROM events)
SELECT 'first' AS turn, k AS kind, n::BIGINT AS n FROM (SELECT unnest(['runs', 'analyzers', 'artifacts', 'records', 'edges']) AS k, unnest([runs, analyzers, analyzers, records, runs + 2 * analyzers]) AS n FROM u)""",
    "g6_validate_versions": """WITH r AS (SELECT l_orderkey AS id, count(*) AS records, count_if(NOT (l_quantity >= 0 AND l_quantity + l_extendedprice - 5000 > l_quantity)) AS bad FROM lineitem GROUP BY 1),
v AS (SELECT vec_id AS id, count(*) AS vectors FROM embeddings GROUP BY 1)
SELECT o_orderkey AS index_version_id, coalesce(records, 0)::BIGINT AS records, coalesce(vectors, 0)::BIGINT AS vectors,
  coalesce(records, 0) = 5 AND coalesce(bad, 0) = 0 AND (coalesce(vectors, 0) = 0 OR coalesce(vectors = records, false)) AS ready
FROM orders LEFT JOIN r ON r.id = o_orderkey LEFT JOIN v ON v.id = o_orderkey""",
    "a19_resolve": """WITH a AS (SELECT o_custkey AS c, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS x FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' GROUP BY 1),
v AS (SELECT o_custkey AS c, max(o_orderkey) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey::VARCHAR AS name, coalesce(a.x, v.x) AS index_version_id FROM customer LEFT JOIN a ON a.c = c_custkey LEFT JOIN v ON v.c = c_custkey""",
    "g13_next_versions": "SELECT o_orderkey AS name, (coalesce(max(l_linenumber), 0) + 1)::INT AS version FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "j11_lineage": """SELECT 'region:' || n_regionkey AS root, 1 AS depth, count(*)::BIGINT AS n FROM nation GROUP BY 1
UNION ALL SELECT 'region:' || n_regionkey, 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT 'region:' || n_regionkey, 3, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "g14_progress": f"""WITH {_STATUS} SELECT source_file, count(*)::BIGINT AS chunks, count_if(status <> 'failed')::BIGINT AS done, count_if(status = 'failed')::BIGINT AS failed, true AS complete FROM s GROUP BY 1""",
    "g9_run_report": f"""WITH {_STATUS} SELECT count(DISTINCT source_file)::BIGINT AS files, count_if(status = 'new')::BIGINT AS chunks_new, count_if(status = 'skipped')::BIGINT AS chunks_skipped,
  count_if(status = 'still')::BIGINT AS chunks_still, count_if(status = 'failed')::BIGINT AS chunks_failed, count(*)::BIGINT AS chunks FROM s""",
    "g8_timings": "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS spread, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2",
    "g3_store_stats": "SELECT count(*)::BIGINT AS chunks, count(DISTINCT source)::BIGINT AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS source_list FROM documents",
    "g2_modality_counts": "SELECT role AS modality, count(*)::BIGINT AS n FROM conversations GROUP BY 1",
    "s9_upsert": "SELECT o_orderkey AS id, round(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '1%'",
    "s12_insert_absent": """WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS key, source FROM documents)
SELECT min(doc_id) AS doc_id, key FROM t WHERE source <> 'src0' AND key NOT IN (SELECT key FROM t WHERE source = 'src0') GROUP BY key""",
    "u5_merge_categories": "SELECT c_custkey AS path, CASE WHEN c_acctbal < 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS category FROM customer",
    "j9_apply_categories": "SELECT page_id AS path, coalesce(lang, 'Unsorted') AS category FROM pages LEFT JOIN documents ON doc_id = page_id",
    "a24_distinct_moments": """SELECT l_partkey AS source_file, min(l_orderkey * 8 + l_linenumber) AS rank FROM lineitem
GROUP BY l_partkey, round(l_quantity / 0.01::DOUBLE), round((l_quantity + l_discount) / 0.01::DOUBLE)""",
    "g4_architecture_stats": """SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'ready_versions', count(*) FROM orders WHERE o_orderstatus = 'F'""",
    "p25_descriptors": f"""WITH {CHUNKS} SELECT id, substr(source_file, 6) AS file_name, substr(sha256(source_file || ':0'), 1, 16) AS media_id, printf('%.1f-%.1f', start_time, end_time) AS span FROM chunks""",
    "u3_requested_sources": f"WITH {CHUNKS} SELECT DISTINCT source_file FROM chunks WHERE source_file IN (SELECT printf('/lib/%02d.mp4', n_nationkey * 2) FROM nation)",
    "sql_functions": """WITH o AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS d FROM orders), h AS (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS a, (embedding::DOUBLE[])[33:64] AS b FROM embeddings)
SELECT 'order' AS kind, o_orderkey AS id, greatest(1, ceil((d - 5000) / 25000.0))::DOUBLE AS x, d::DOUBLE AS y FROM o
UNION ALL SELECT 'vector', vec_id, round(list_cosine_similarity(a, b), 6), round(a[1] / sqrt(list_dot_product(a, a)), 6) FROM h""",
}
