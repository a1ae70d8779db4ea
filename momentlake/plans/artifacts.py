"""Understanding runs, artifacts and index versions as tables: validation, idempotent import, index build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.functions.moments import first_segments, fixed_windows, valid_interval
from momentlake.functions.text import content_hash, labelled_lines
from momentlake.functions.vectors import is_valid
from momentlake.operators.semantic import vector_from_field
from momentlake.operators.structured import field
from momentlake.plans.ingest import Embedder, embed
from momentlake.sources.shared import shared_path


def new_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the parts' SHA-256, so that a repeated run makes the same ids."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(24)))


@dataclass
class Imported:
    runs: DataFrame
    analyzers: DataFrame
    artifacts: DataFrame
    records: DataFrame
    edges: DataFrame


def invalid_records(outputs: DataFrame) -> DataFrame:
    """key, problem of outputs (media_id, key, name, artifact_type, segment_id, start_ms, end_ms, data): what an import refuses."""
    bad = outputs.filter(~valid_interval(F.col("start_ms"), F.col("end_ms"))).select("key", F.lit("interval").alias("problem"))
    shape = outputs.filter(F.coalesce(~F.schema_of_variant("data").startswith("OBJECT"), F.lit(True))).select("key", F.lit("not an object").alias("problem"))
    twice = outputs.groupBy("media_id", "key", "name", "segment_id").count().filter("count > 1").select("key", F.lit("duplicate segment").alias("problem"))
    return bad.unionByName(shape).unionByName(twice).distinct()


def request_hashes(outputs: DataFrame) -> DataFrame:
    """key, media_id, request_hash: the number of a run's records and four sums over their digests, which no order changes and no list is gathered for."""
    one = F.sha2(F.concat_ws("\x1f", "name", "artifact_type", "segment_id", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.to_json("data")), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    rows = outputs.select("key", "media_id", one.alias("h")).groupBy("key", "media_id").agg(F.count("*").cast("string").alias("n"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return rows.select("key", "media_id", content_hash(F.concat_ws(":", "n", *(f"p{i}" for i in range(4)))).alias("request_hash"))


def conflicts(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that come again under their key with other records."""
    known = runs.select("media_id", "key", F.col("request_hash").alias("known"))
    return request_hashes(outputs).join(known, ["media_id", "key"]).filter("known <> request_hash")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def understand(outputs: DataFrame, runs: DataFrame) -> Imported:
    """The new rows that outputs add to what runs (media_id, key, request_hash) hold; a repeated run adds none.

    Raises ValueError on invalid records or on a known key with other records. Outputs are made once, and written, as
    checks, hashes and all that is imported read them.
    """
    outputs = staged(outputs, "outputs")
    if not invalid_records(outputs).isEmpty():
        raise ValueError("invalid records")
    hashes = staged(request_hashes(outputs), "hashes")  # read for conflicts, runs and all that hangs on them
    known = runs.select("media_id", "key", F.col("request_hash").alias("known"))
    if not hashes.join(known, ["media_id", "key"]).filter("known <> request_hash").isEmpty():
        raise ValueError("idempotency key used with another request")
    fresh = hashes.join(runs.select("media_id", "key"), ["media_id", "key"], "left_anti")
    new_runs = fresh.select(new_id("run", F.col("media_id"), F.col("key")).alias("id"), "media_id", "key", "request_hash", F.lit("completed").alias("status"))
    # ids follow from what a row holds, so rows are joined with the known runs only, where there are any
    rows = outputs.filter("media_id is not null and key is not null")
    if not runs.isEmpty():
        rows = staged(rows.join(runs.select("media_id", "key"), ["media_id", "key"], "left_anti"), "rows")
    rows = rows.withColumn("run_id", new_id("run", F.col("media_id"), F.col("key"))).withColumn("analyzer_run_id", new_id("analyzer", F.col("run_id"), F.col("name"))).withColumn("artifact_id", new_id("artifact", F.col("analyzer_run_id")))
    analyzers = rows.select(F.col("analyzer_run_id").alias("id"), "run_id", "name").distinct()
    artifacts = rows.groupBy(F.col("artifact_id").alias("id"), "analyzer_run_id", "media_id", "artifact_type").agg(F.count("*").alias("record_count"), F.lit("completed").alias("status"))
    records = rows.select(new_id("record", F.col("artifact_id"), F.col("segment_id")).alias("id"), "artifact_id", "media_id", "segment_id", "start_ms", "end_ms", "data")
    steps = (("media", "media_id", "run", "run_id"), ("run", "run_id", "analyzer", "analyzer_run_id"), ("analyzer", "analyzer_run_id", "artifact", "artifact_id"))
    edges = None
    for parent, p, child, c in steps:
        part = rows.select(F.lit(parent).alias("parent_type"), F.col(p).alias("parent_id"), F.lit(child).alias("child_type"), F.col(c).alias("child_id")).distinct()
        edges = part if edges is None else edges.unionByName(part)
    return Imported(new_runs, analyzers, artifacts, records, edges)


@dataclass(frozen=True)
class IndexDefinition:
    name: str
    artifact_type: str
    semantic_fields: tuple[str, ...] = ()
    filter_fields: tuple[str, ...] = ()
    aggregate_fields: tuple[str, ...] = ()
    sort_fields: tuple[str, ...] = ()
    source_embedding_field: str | None = None

    def fields(self) -> set[str]:
        return {*self.semantic_fields, *self.filter_fields, *self.aggregate_fields, *self.sort_fields}


def build_index(records: DataFrame, definition: IndexDefinition, version: int) -> DataFrame:
    """index_version_id, artifact_record_id, media_id, start_ms, end_ms, data, semantic_text of an artifact's records.

    Every field of the definition must occur in one record at least, and every record must have some semantic text
    where the definition asks for it.
    """
    found = records.agg(*(F.count(field(F.col("data"), f)).alias(f"f{i}") for i, f in enumerate(sorted(definition.fields())))).first() if definition.fields() else ()
    missing = [f for f, n in zip(sorted(definition.fields()), found, strict=True) if not n]
    if missing:
        raise ValueError(f"fields in no record: {missing}")

    def text(path: str) -> Column:
        v = field(F.col("data"), path)
        parts = F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: F.trim(x) != "")
        return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(parts, ", ")).otherwise(F.try_variant_get(v, "$", "string"))

    lines = labelled_lines({f: text(f) for f in definition.semantic_fields}) if definition.semantic_fields else F.lit("")
    if definition.semantic_fields:
        empty = F.raise_error(F.concat(F.lit("semantic fields give no text for the record "), F.col("id").cast("string"))).cast("string")
        lines = F.when(lines == "", empty).otherwise(lines)
    version_id = new_id("index", F.lit(definition.name), F.lit(str(version)))
    return records.select(version_id.alias("index_version_id"), F.col("id").alias("artifact_record_id"), "media_id", "start_ms", "end_ms", "data", lines.alias("semantic_text"))


def validate_version(index: DataFrame, expected: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per version: records, whether they match expected (index_version_id, record_count), intervals and vectors are sound."""
    rows = index.groupBy("index_version_id").agg(F.count("*").alias("records"), F.count_if(~valid_interval(F.col("start_ms"), F.col("end_ms"))).alias("bad_intervals"))
    vectors = embeddings.groupBy("index_version_id").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    joined = expected.join(rows, "index_version_id", "left").join(vectors, "index_version_id", "left")
    ok = (F.coalesce("records", F.lit(0)) == F.col("record_count")) & (F.coalesce("bad_intervals", F.lit(0)) == 0) & (F.coalesce("vectors", F.lit(0)).isin(0) | ((F.col("vectors") == F.col("records")) & (F.col("low") == F.col("high"))))
    return joined.select("index_version_id", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("vectors", F.lit(0)).alias("vectors"), ok.alias("ready"))


def index_vectors(index: DataFrame, definition: IndexDefinition, embedder: Embedder, dimension: int) -> DataFrame:
    """index_version_id, artifact_record_id, field_name, embedding, source_text_hash of an index's records.

    Vectors are those at the definition's source_embedding_field, or of the semantic texts; a definition without
    either gives none. A vector that is not finite or of another dimension is an error.
    """
    path = definition.source_embedding_field
    if path:
        rows = index.withColumns({"embedding": vector_from_field(F.col("data"), path, dimension), "source": F.to_json(field(F.col("data"), path))})
    elif definition.semantic_fields:
        rows = embed(index.select("index_version_id", "artifact_record_id", F.col("semantic_text").alias("source")), "source", embedder)
        wrong = F.raise_error(F.concat(F.lit("no valid vector of a record: "), F.coalesce("error", F.col("artifact_record_id").cast("string")))).cast("array<double>")
        rows = rows.withColumn("embedding", F.when(is_valid(F.col("vector"), dimension), F.col("vector")).otherwise(wrong))
    else:
        rows = index.limit(0).withColumns({"embedding": F.array().cast("array<double>"), "source": F.lit("")})
    name = path or ",".join(definition.semantic_fields)
    return rows.select("index_version_id", "artifact_record_id", F.lit(name).alias("field_name"), F.col("embedding").cast("array<float>").alias("embedding"), content_hash(F.col("source")).alias("source_text_hash"))


@dataclass
class Published:
    index: DataFrame
    embeddings: DataFrame
    status: DataFrame


def check_artifacts(records: DataFrame, definition: IndexDefinition, artifacts: DataFrame | None = None) -> None:
    """Raises ValueError if there is no record, or if artifacts (id, artifact_type, status) of records (artifact_id) are unknown, of another type than the definition's or not completed."""
    if records.isEmpty():
        raise ValueError("cannot index an empty artifact")
    if artifacts is None:
        return
    used = records.select(F.col("artifact_id").alias("id")).distinct().join(artifacts, "id", "left")
    wrong = used.filter(F.coalesce((F.col("artifact_type") != definition.artifact_type) | (F.col("status") != "completed"), F.lit(True))).first()
    if wrong:
        raise ValueError(f"index {definition.name!r} needs completed artifacts of type {definition.artifact_type!r}; {wrong.id} is {wrong.status} and of type {wrong.artifact_type!r}")


def publish_index(records: DataFrame, definition: IndexDefinition, version: int, embedder: Embedder, dimension: int, path: str, artifacts: DataFrame | None = None) -> Published:
    """Builds an index version under path: records, then vectors, then, once both are validated, its status row. What check_artifacts() refuses is not built.

    A reader that goes by the status row never sees half an index; without vectors for all records it says failed.
    """
    spark = records.sparkSession
    check_artifacts(records, definition, artifacts)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    index = written(build_index(records, definition, version), "records")
    vectors = written(index_vectors(index, definition, embedder, dimension), "embeddings")
    version_id = new_id("index", F.lit(definition.name), F.lit(str(version)))
    expected = records.agg(F.count("*").alias("record_count")).select(version_id.alias("index_version_id"), "record_count")
    checked = validate_version(index, expected, vectors)
    status = checked.select("index_version_id", F.lit(definition.name).alias("name"), F.lit(version).alias("version"), "records", "vectors", F.when(F.col("ready"), "ready").otherwise("failed").alias("status"))
    return Published(index, vectors, written(status, "status"))


def vector_outputs(media: DataFrame, embedder: Embedder, dimension: int, key: str, name: str, chunk_ms: int = 30_000, overlap_ms: int = 5_000, max_segments: int | None = None) -> DataFrame:
    """What understand() imports from a vector analyzer: a record {"vector": [...]} for each span of media (media_id, duration_ms, payload).

    Spans are fixed windows, the first max_segments of them; a span's payload is the medium's and the span's number.
    """
    if max_segments is not None and max_segments < 1:
        raise ValueError("max_segments must be positive")
    spans = first_segments(fixed_windows(F.col("duration_ms"), chunk_ms, overlap_ms), max_segments)
    each = media.select("media_id", "payload", F.explode(spans).alias("w"))
    rows = each.select("media_id", F.format_string("segment_%06d", "w.i").alias("segment_id"), "w.start_ms", "w.end_ms", F.concat_ws(" ", "payload", F.col("w.i").cast("string")).alias("payload"))
    done = embed(rows, "payload", embedder)
    wrong = F.raise_error(F.concat(F.lit("no valid vector of a span: "), F.coalesce("error", "segment_id"))).cast("array<double>")
    vector = F.when(is_valid(F.col("vector"), dimension), F.col("vector")).otherwise(wrong)
    data = F.parse_json(F.to_json(F.struct(vector.alias("vector"))))
    return done.select("media_id", F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit("video_embedding").alias("artifact_type"), "segment_id", "start_ms", "end_ms", data.alias("data"))
