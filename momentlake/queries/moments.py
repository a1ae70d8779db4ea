"""Segments, spans, texts, files and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import moments as M
from momentlake.functions import text as T
from momentlake.operators import anomalies, frames, records
from momentlake.plans import ingest
from momentlake.queries._tables import r6, table
from momentlake.sources import media


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.format_string("/media/%d.mp4", "o_orderkey").alias("source_file"), F.round("o_totalprice").cast("long").alias("duration_ms"), "o_orderstatus")


_MEDIA = "media AS (SELECT '/media/' || o_orderkey || '.mp4' AS source_file, round(o_totalprice)::BIGINT AS duration_ms, o_orderstatus FROM orders)"
_SEGMENTS = f"""{_MEDIA}, w AS (SELECT source_file, o_orderstatus, duration_ms, i AS segment, i * 25000 AS s, least(i * 25000 + 30000, duration_ms) AS e
  FROM (SELECT *, unnest(range(0, greatest(1, ceil((duration_ms - 5000) / 25000.0))::BIGINT)) AS i FROM media)),
segments AS (SELECT substr(sha256(source_file || ':' || (segment * 25)), 1, 16) AS id, source_file, segment, s / 1000.0::DOUBLE AS start_time, e / 1000.0::DOUBLE AS end_time, o_orderstatus FROM w)"""


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return ingest.segments(_durations(spark, d))


def _dealt(spark: SparkSession, d: str, most: int = 1_000_000) -> DataFrame:
    """Media dealt by source before their segments are cut, so that rows of media are shuffled and not their segments; about `most` segments a part, which a task sorts in memory."""
    rows = _durations(spark, d)
    segments = rows.agg(F.sum(F.col("duration_ms") / 25_000 + 1)).first()[0] or 0
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(segments // most) + 1), "source_file")


def j7_pending(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left to index: those of orders with status F are stored, the first chunks of those with status P have failed."""
    expected = ingest.segments(_dealt(spark, d), keep=("o_orderstatus",))
    stored, failed = expected.filter("o_orderstatus = 'F'"), expected.filter("o_orderstatus = 'P' and segment = 0")
    return records.pending(expected, stored, failed).select("id", "source_file", "segment")


def j7_complete_files(spark: SparkSession, d: str) -> DataFrame:
    expected = ingest.segments(_dealt(spark, d))
    return records.complete_files(expected, expected.filter("start_time < 100"))


def a23_frame_times(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "part"), (F.col("p_size") % 8 + 1).cast("int")
    price = F.col("p_retailprice")
    both = F.arrays_zip(M.midpoint_times(price, n).alias("mid"), M.interior_times(price, n).alias("inner"))
    return p.select("p_partkey", F.posexplode(both).alias("i", "t")).select("p_partkey", "i", r6("t.mid").alias("midpoint"), r6("t.inner").alias("interior"))


def p16_formats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", M.format_duration(F.col("o_totalprice") / 10).alias("duration"), M.format_bytes((F.col("o_totalprice") * 100).cast("long")).alias("size"), M.segment_id(F.col("o_orderkey")).alias("segment"))


def p17_clip_plan(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    start, end = F.col("l_quantity"), F.col("l_quantity") + F.round("l_extendedprice").cast("long") % 97 / 10.0
    path = F.format_string("/lib/part %d.v1.mp4", "l_partkey")
    a, b = M.clip_start(start), M.clip_end(end, F.lit(55.0))
    rows = li.select("l_orderkey", "l_linenumber", path.alias("path"), a.alias("clip_start"), r6(b).alias("clip_end"), M.clip_name(path, a, b).alias("name"), r6((a + b) / 2).alias("preview"))
    return rows.filter(M.valid_interval(F.col("clip_start"), F.col("clip_end"))).drop("path")


def j6_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spans of one user and type that overlap by a fifth of the shorter one."""
    start = F.unix_micros("ts") / 1e6
    spans = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("id"), start.alias("s"), (start + F.col("value") * 60).alias("e"))
    near = records.overlapping(spans, ["user_id", "event_type"], 3600.0)
    ratio = M.overlap_ratio(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b"))
    return near.withColumn("ratio", F.round(ratio, 4)).filter("ratio >= 0.2").select(F.col("id_a").alias("event_id_a"), F.col("id_b").alias("event_id_b"), "ratio")


def t3_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    from momentlake.streaming.ingest import sliding_counts

    w = sliding_counts(table(spark, d, "events"), "3000 seconds", "2500 seconds")
    return w.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def t1_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events come in as a stream, twice, and are upserted by id into a snapshot table."""
    from momentlake.sources.shared import shared_path
    from momentlake.sources.snapshots import SnapshotTable
    from momentlake.streaming.ingest import ingest as start
    from momentlake.streaming.ingest import read_records

    home = shared_path(spark, "ingest")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    out = SnapshotTable(spark, f"{home}/table", schema)
    for turn in ("first", "again"):
        start(read_records(spark, f"{d}/events.parquet*", schema), out, f"{home}/checkpoint-{turn}", "event_id").awaitTermination()
    return out.read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


def p15_categories(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", T.category_of_path(F.col("url")).alias("category"), T.category_of_path(F.col("html")).alias("html_category"), T.mime_of_path(F.col("url")).alias("mime_type"))


def g5_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(T.category_of_path(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files below /data/target, some of other kinds and some in folders that scans leave out."""
    parts = F.array(*(F.lit(x) for x in ("clips", "node_modules", "Target", ".git", "2024")))
    kinds = F.array(*(F.lit(x) for x in (".MP4", ".mov", ".txt", ".mts", ".mpeg", "", ".mp4.txt")))
    name = F.concat(F.lit("/data/target/"), parts[(F.col("doc_id") % 5).cast("int")], F.lit("/"), F.col("source"), F.lit("/v"), F.col("doc_id").cast("string"), kinds[(F.col("doc_id") % 7).cast("int")])
    return table(spark, d, "documents").select(name.alias("path"), F.col("n_chars").alias("length"), F.lit(0).alias("modified"))


def s1_media_scan(spark: SparkSession, d: str) -> DataFrame:
    """Which of the paths made from documents a scan returns."""
    return media.catalog(media.media_paths(_files(spark, d), "/data/target")).select("path", "length", "file_name", "parent_name", "mime_type", "category")


def u1_union_of_roots(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of overlapping roots, one of which is a folder that scans leave out below other roots."""
    roots = ("/data/target", "/data/target/clips/", "/data/target/node_modules")
    return media.united(_files(spark, d), roots).select("path", "length", "parent_name", "category")


def p12_evidence(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.evidence(text), "UTF-8")).alias("evidence"), F.length(T.short_error(text)).alias("error_length"), T.is_permanent_failure(text).alias("permanent"))


def p21_terms(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.array_join(T.terms(F.col("text"), 12), " ").alias("terms"))


def g10_observations(spark: SparkSession, d: str) -> DataFrame:
    """Turns as text observations of a conversation: of equal normalized texts the longest, in order."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("text"))
    rows = c.select(F.col("conv_id").alias("segment_id"), "text", T.collapse_spaces(F.col("text")).alias("normalized"), F.length("text").alias("confidence"), (F.col("turn") * 1000).alias("frame_ms"))
    return records.observations(rows).select("segment_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Pages as frames of 16 pixels a row; four of them are a span."""
    rgb = F.encode("html", "UTF-8")
    height = F.greatest(F.floor(F.octet_length(rgb) / 48), F.lit(1)).cast("int")
    return table(spark, d, "pages").select(F.floor(F.col("page_id") / 4).cast("long").alias("span_id"), (F.col("page_id") % 4).cast("int").alias("frame_idx"), F.lit(16).alias("width"), height.alias("height"), rgb.alias("rgb"))


def m5_span_features(spark: SparkSession, d: str) -> DataFrame:
    out = frames.span_features(_frames(spark, d))
    return out.select("span_id", F.posexplode("embedding").alias("i", "x")).select("span_id", "i", r6("x").alias("x"))


def m6_still_spans(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.still_spans(_frames(spark, d))


def a21_frame_differences(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_differences(_frames(spark, d)).select("span_id", "frame_idx", r6("difference").alias("difference"))


def a22_changed_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.changed_frames(_frames(spark, d), 25.0).select("span_id", "frame_idx")


def p23_text_features(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    out = frames.text_features(named)
    return out.select("query_id", F.posexplode("embedding").alias("i", "x")).filter("x <> 0").select("query_id", "i", r6("x").alias("x"))


QUERIES = {f.__name__: f for f in (p1_segments, j7_pending, j7_complete_files, a23_frame_times, p16_formats, p17_clip_plan, j6_interval_overlap, t3_sliding_windows, t1_stream_ingest, p15_categories, g5_category_counts, s1_media_scan, u1_union_of_roots, p12_evidence, p21_terms, g10_observations, m5_span_features, m6_still_spans, a21_frame_differences, a22_changed_frames, p23_text_features)}


def _case(column: str) -> str:
    low = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{'|'.join(w)}') THEN '{c}'" for c, w in T.CATEGORY_WORDS.items()) + " ELSE 'Unsorted' END"


_NAME = "printf('%02dm%02ds', round({x})::BIGINT // 60, round({x})::BIGINT % 60)"

_BYTES = """b AS (SELECT page_id // 4 AS span_id, (page_id % 4)::INT AS frame_idx,
  list_transform(regexp_extract_all(hex(encode(coalesce(html, ''))), '..'), lambda x: ('0x' || x)::INT) AS b FROM pages)"""
_APART = "CASE WHEN least(len({x}), len({y})) = 0 THEN 0 ELSE list_avg(list_transform(list_zip({x}, {y}, true), lambda z: abs(z[1] - z[2]))) / 255 END"

_LUMA = "CASE WHEN px = 0 THEN 0 ELSE list_sum(list_transform(b[1:px * 3], lambda x, i: x * [0.299::DOUBLE, 0.587, 0.114][(i - 1) % 3 + 1])) / px / 255 END"
_UNIT = "x / CASE WHEN sqrt(sum(x * x) OVER ({0})) > 1e-12 THEN sqrt(sum(x * x) OVER ({0})) ELSE 1 END"
_COLOURS = ", ".join(f"('{word}', {r}, {g}, {b})" for word, (r, g, b) in frames.COLOURS.items())
_BUMPS = ", ".join(f"({[*words]}, {block}, {at}, {x}::DOUBLE)" for words, block, at, beside in ((frames.DARK, 2, 112, 113), (frames.BRIGHT, 2, 119, 118), (frames.FAST, 3, 123, 122), (frames.STILL, 3, 120, 121)) for at, x in ((at, 1.0), (beside, 0.5)))

SQL = {
    "m5_span_features": f"""WITH {_BYTES}, f AS (SELECT span_id, frame_idx, b, len(b) // 3 AS px, greatest(len(b) // 48, 1) AS h, count(*) OVER (PARTITION BY span_id) AS n, lag(b) OVER (PARTITION BY span_id ORDER BY frame_idx) AS p FROM b),
x AS (SELECT span_id, frame_idx, n, h, unnest(range(px)) AS i, unnest(b[1:px * 3:3]) AS r, unnest(b[2:px * 3:3]) AS g, unnest(b[3:px * 3:3]) AS u FROM f),
cell AS (SELECT span_id, frame_idx, n, least(i // 16 // ((h + 3) // 4), 3) * 4 + least(i % 16 // 4, 3) AS c, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(u) / 255 AS u FROM x GROUP BY ALL),
part AS (SELECT span_id, 0 AS block, r // 64 * 16 + g // 64 * 4 + u // 64 AS i, count(*)::DOUBLE / first(n) AS x FROM x GROUP BY ALL
  UNION ALL SELECT span_id, 1, 64 + c * 3 + k, sum(x) / first(n) FROM (SELECT span_id, n, c, unnest([0, 1, 2]) AS k, unnest([r, g, u]) AS x FROM cell) GROUP BY span_id, c, k
  UNION ALL SELECT span_id, 2, 112 + least(floor(luma * 8), 7)::INT, count(*)::DOUBLE / first(n) FROM (SELECT span_id, n, {_LUMA} AS luma FROM f) GROUP BY ALL
  UNION ALL SELECT span_id, 3, 120 + (d >= 0.01)::INT + (d >= 0.05)::INT + (d >= 0.15)::INT, count(*)::DOUBLE FROM (SELECT span_id, {_APART.format(x="p", y="b")} AS d FROM f WHERE p IS NOT NULL) GROUP BY ALL),
u AS (SELECT span_id, i, {_UNIT.format("PARTITION BY span_id, block")} AS x FROM part),
e AS (SELECT span_id, i, coalesce(x, 0) AS x FROM (SELECT DISTINCT span_id, unnest(range(124)) AS i FROM b) LEFT JOIN u USING (span_id, i))
SELECT span_id, i::INT AS i, round({_UNIT.format("PARTITION BY span_id")}, 6) AS x FROM e""",
    "p23_text_features": f"""WITH q AS (SELECT p_partkey AS query_id, regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+') AS w FROM part),
c(word, r, g, b) AS (VALUES {_COLOURS}), k(words, block, i, x) AS (VALUES {_BUMPS}),
d(dr, dg, db, x) AS (VALUES (0, 0, 0, 1::DOUBLE), (1, 0, 0, 0.5), (-1, 0, 0, 0.5), (0, 1, 0, 0.5), (0, -1, 0, 0.5), (0, 0, 1, 0.5), (0, 0, -1, 0.5)),
part AS (SELECT query_id, 0 AS block, (r + dr) * 16 + (g + dg) * 4 + b + db AS i, sum(x) AS x FROM (SELECT query_id, unnest(w) AS word FROM q) JOIN c USING (word), d
    WHERE r + dr BETWEEN 0 AND 3 AND g + dg BETWEEN 0 AND 3 AND b + db BETWEEN 0 AND 3 GROUP BY ALL
  UNION ALL SELECT query_id, block, i, sum(x) FROM q JOIN k ON list_has_any(w, words) GROUP BY ALL),
u AS (SELECT query_id, i, {_UNIT.format("PARTITION BY query_id, block")} AS x FROM part)
SELECT query_id, i::INT AS i, round({_UNIT.format("PARTITION BY query_id")}, 6) AS x FROM u""",
    "m6_still_spans": f"""WITH {_BYTES}, n AS (SELECT span_id, len(b) // 3 AS px, b FROM b),
l AS (SELECT span_id, {_LUMA} AS luma FROM n)
SELECT span_id FROM l GROUP BY span_id HAVING count(*) >= 2 AND max(luma) > 0 AND max(luma) - min(luma) < 0.03""",
    "a21_frame_differences": f"""WITH {_BYTES}, l AS (SELECT *, lag(b) OVER (PARTITION BY span_id ORDER BY frame_idx) AS p FROM b)
SELECT span_id, frame_idx, CASE WHEN p IS NOT NULL THEN round({_APART.format(x="p", y="b")}, 6) END AS difference FROM l""",
    "a22_changed_frames": f"""WITH RECURSIVE {_BYTES}, f AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY frame_idx) AS n FROM b),
w AS (SELECT span_id, frame_idx, n, true AS stays, b AS last FROM f WHERE n = 1
  UNION ALL SELECT f.span_id, f.frame_idx, f.n, {_APART.format(x="last", y="b")} * 255 >= 25, CASE WHEN {_APART.format(x="last", y="b")} * 255 >= 25 THEN b ELSE last END
  FROM w JOIN f ON f.span_id = w.span_id AND f.n = w.n + 1)
SELECT span_id, frame_idx FROM w WHERE stays""",
    "p1_segments": f"WITH {_SEGMENTS} SELECT id, source_file, segment, start_time, end_time FROM segments",
    "j7_pending": f"WITH {_SEGMENTS} SELECT id, source_file, segment FROM segments WHERE NOT (o_orderstatus = 'F' OR (o_orderstatus = 'P' AND segment = 0))",
    "j7_complete_files": f"WITH {_SEGMENTS} SELECT source_file FROM segments GROUP BY source_file HAVING bool_and(start_time < 100)",
    "a23_frame_times": """SELECT p_partkey, i::INT AS i, round(p_retailprice * (i + 0.5::DOUBLE) / n, 6) AS midpoint, round(p_retailprice * (i + 1) / (n + 1), 6) AS interior
FROM (SELECT p_partkey, p_retailprice, p_size % 8 + 1 AS n, unnest(range(0, p_size % 8 + 1)) AS i FROM part)""",
    "p16_formats": """WITH x AS (SELECT o_orderkey, round(o_totalprice / 10)::BIGINT AS s, (o_totalprice * 100)::DECIMAL(18, 0)::BIGINT AS b0, trunc(o_totalprice * 100)::BIGINT AS b FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration,
  CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS size,
  printf('segment_%06d', o_orderkey) AS segment FROM x""",
    "p17_clip_plan": f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity - 2, 0) AS a, least(l_quantity + round(l_extendedprice)::BIGINT % 97 / 10.0::DOUBLE + 2, 55.0) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a AS clip_start, round(b, 6) AS clip_end, 'match_part ' || l_partkey || '.v1_' || {_NAME.format(x="a")} || '-' || {_NAME.format(x="b")} || '.mp4' AS name, round((a + b) / 2, 6) AS preview FROM s WHERE a >= 0 AND round(b, 6) > a""",
    "j6_interval_overlap": """WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS e FROM events),
p AS (SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, round(greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) / greatest(least(a.e - a.s, b.e - b.s), 0.001::DOUBLE), 4) AS ratio
  FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e) SELECT * FROM p WHERE ratio >= 0.2""",
    "t3_sliding_windows": """WITH w AS (SELECT event_type, value, unnest([x // 2500 * 2500, x // 2500 * 2500 - 2500]) AS s, x FROM (SELECT *, epoch_us(ts) // 1000000 AS x FROM events))
SELECT s::BIGINT AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM w WHERE x < s + 3000 GROUP BY s, event_type""",
    "t1_stream_ingest": "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS ids, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "p15_categories": f"""SELECT page_id, {_case("url")} AS category, {_case("html")} AS html_category,
  CASE lower(regexp_extract(url, '[^/]\\.([^./]+)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MIME_TYPES.items())} ELSE 'application/octet-stream' END AS mime_type FROM pages""",
    "g5_category_counts": f"SELECT {_case('text')} AS category, count(*)::BIGINT AS n FROM documents GROUP BY 1",
    "s1_media_scan": f"""WITH f AS (SELECT '/data/target/' || ['clips', 'node_modules', 'Target', '.git', '2024'][doc_id % 5 + 1] || '/' || source || '/v' || doc_id || ['.MP4', '.mov', '.txt', '.mts', '.mpeg', '', '.mp4.txt'][doc_id % 7 + 1] AS path, source, n_chars AS length, doc_id FROM documents)
SELECT path, length, regexp_extract(path, '[^/]*$') AS file_name, source AS parent_name, CASE WHEN path LIKE '%.MP4' THEN 'video/mp4' WHEN path LIKE '%.mov' THEN 'video/quicktime' ELSE 'video/mpeg' END AS mime_type, {_case("path")} AS category
FROM f WHERE doc_id % 7 IN (0, 1, 4) AND doc_id % 5 IN (0, 4)""",
    "u1_union_of_roots": f"""WITH f AS (SELECT '/data/target/' || ['clips', 'node_modules', 'Target', '.git', '2024'][doc_id % 5 + 1] || '/' || source || '/v' || doc_id || ['.MP4', '.mov', '.txt', '.mts', '.mpeg', '', '.mp4.txt'][doc_id % 7 + 1] AS path, source, n_chars AS length, doc_id FROM documents)
SELECT path, length, source AS parent_name, {_case("path")} AS category FROM f WHERE doc_id % 7 IN (0, 1, 4) AND doc_id % 5 IN (0, 1, 4)""",
    "p12_evidence": """SELECT doc_id, md5(CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END) AS evidence, length(left(text, 500))::INT AS error_length,
  regexp_matches(lower(text), 'oom|out of memory|invalid data|could not decode|no such file') AS permanent FROM documents""",
    "p21_terms": "SELECT item_id, array_to_string(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')[1:12], ' ') AS terms FROM benchmark",
    "g10_observations": """WITH c AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text FROM conversations),
n AS (SELECT conv_id, turn * 1000 AS ms, text, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS k FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY length(text) DESC, ms, text) AS r FROM n WHERE k <> '')
SELECT conv_id AS segment_id, md5(string_agg(text, ' ' ORDER BY ms, text)) AS text_md5 FROM b WHERE r = 1 GROUP BY conv_id""",
}
