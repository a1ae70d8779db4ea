"""Set operations on records, versions, aliases, edges, ranked results and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentlake.sources.shared import shared_path


def _held(expected: DataFrame, known: DataFrame) -> DataFrame:
    """expected with _held: whether known (source_file, id) has the chunk. Rows of a source meet where they are: what is dealt by source_file is not shuffled again."""
    ids = known.select("source_file", "id").filter("id is not null and source_file is not null").withColumn("_known", F.lit(True))
    rows = expected.withColumn("_known", F.lit(False)).unionByName(ids, allowMissingColumns=True)
    held = F.max("_known").over(W.partitionBy("source_file", "id"))
    return rows.withColumn("_held", held).filter("not _known").drop("_known")


def pending(expected: DataFrame, stored: DataFrame, failed: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Chunks (id) that are not stored and, unless they are retried, have not failed.

    Where all three have source_file, chunks are compared within their sources: segments of media that were dealt by
    source_file before they were cut are then not shuffled. Else they are compared by id.
    """
    known = [stored] if retry_failed else [stored, failed]
    if all("source_file" in df.columns for df in (expected, *known)):
        ids = reduce(DataFrame.unionByName, (df.select("source_file", "id") for df in known))
        return _held(expected, ids).filter("not _held").drop("_held")
    left = expected.join(stored.select("id"), "id", "left_anti")
    return left if retry_failed else left.join(failed.select("id"), "id", "left_anti")


def complete_files(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources all of whose expected chunks (source_file, id) are stored; compared within sources where stored has source_file, as in pending()."""
    if "source_file" in stored.columns:
        held = _held(expected.select("source_file", "id"), stored).withColumnRenamed("_held", "held")
    else:
        held = expected.join(stored.select("id", F.lit(True).alias("held")), "id", "left")
    return held.groupBy("source_file").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("ok")).filter("ok").select("source_file")


def progress(status: DataFrame) -> DataFrame:
    """Per source: chunks in all, done, failed, and whether the file is complete, of status (source_file, status)."""
    n = {s: F.count_if(F.col("status") == s) for s in ("new", "skipped", "still", "failed")}
    done = n["new"] + n["skipped"] + n["still"]
    return status.groupBy("source_file").agg(F.count("*").alias("chunks"), done.alias("done"), n["failed"].alias("failed"), (done + n["failed"] == F.count("*")).alias("complete"))


def run_report(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_distinct("source_file").alias("files"),
        *(F.count_if(F.col("status") == s).alias(f"chunks_{s}") for s in ("new", "skipped", "still", "failed")),
        F.count("*").alias("chunks"),
    )


def resolve(versions: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """name, index_version_id: by the alias's last ready version, else the definition's highest ready version.

    versions: index_version_id, name, version, status; aliases: alias, index_version_id, updated_at; names: name.
    """
    ready = versions.filter("status = 'ready'")
    last = aliases.join(ready.select("index_version_id"), "index_version_id", "left_semi").groupBy(F.col("alias").alias("name")).agg(F.max_by("index_version_id", "updated_at").alias("by_alias"))
    highest = ready.groupBy("name").agg(F.max_by("index_version_id", "version").alias("by_version"))
    out = names.join(last, "name", "left").join(highest, "name", "left")
    return out.select("name", F.coalesce("by_alias", "by_version").alias("index_version_id"))


def next_versions(definitions: DataFrame, versions: DataFrame) -> DataFrame:
    last = versions.groupBy("name").agg(F.max("version").alias("last"))
    return definitions.select("name").join(last, "name", "left").select("name", (F.coalesce("last", F.lit(0)) + 1).alias("version"))


def lineage(edges: DataFrame, roots: DataFrame, hops: int = 4) -> DataFrame:
    """root, node, depth: what is reached from roots (id) by at most `hops` edges (parent_id, child_id); shortest depth.

    Each hop starts from the nodes that the last one reached first, which are written, and the hops end when there are none.
    """
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "lineage")
    schema = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")).schema

    def staged(df: DataFrame, depth: int) -> DataFrame:
        df.select("root", "node", F.lit(depth).alias("depth")).write.parquet(f"{path}/{depth}")
        return spark.read.schema(schema).parquet(f"{path}/{depth}")

    links = edges.select(F.col("parent_id").alias("node"), F.col("child_id").alias("child")).distinct()
    links.write.parquet(f"{path}/links")
    links = spark.read.schema(links.schema).parquet(f"{path}/links")
    front = staged(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct(), 0)
    reached, out = front, None
    for depth in range(1, hops + 1):
        steps = front.join(links, "node").select("root", F.col("child").alias("node")).distinct()
        known = reached if depth > 1 else reached.limit(0)  # a root may be reached from itself
        front = staged(steps.join(known.filter("depth > 0").select("root", "node"), ["root", "node"], "left_anti"), depth)
        out, reached = (front if out is None else out.unionByName(front)), reached.unionByName(front)
        if front.isEmpty():
            break
    return out if out is not None else reached.limit(0)


def retrieval_quality(results: DataFrame, truth: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """hit_at_k, mrr and the share of queries without results, of results (query_id, rank, answer) against truth (query_id, expected)."""
    joined = truth.join(results, "query_id", "left")
    first = joined.groupBy("query_id", "expected").agg(F.min(F.when(F.col("answer") == F.col("expected"), F.col("rank"))).alias("at"), F.count("rank").alias("n"))
    hits = [F.avg(F.coalesce(F.col("at") <= k, F.lit(False)).cast("double")).alias(f"hit_at_{k}") for k in cuts]
    return first.agg(F.count("*").alias("queries"), *hits, F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("mrr"), F.avg((F.col("n") == 0).cast("double")).alias("empty_rate"))


def checked_categories(categories: DataFrame, most: int = 10_000) -> DataFrame:
    """categories; raises ValueError for more than `most`, as all of them go to every task."""
    if categories.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} categories")
    return categories


def best_category(chunks: DataFrame, categories: DataFrame, similarity: Column, group: int = 10_000) -> DataFrame:
    """Per source the category (position, name, centre) of its most similar chunk; the earlier category wins ties.

    Where there are more than `group` categories, they go to the tasks in groups, each of which scans the chunks once.
    """
    n = max(1, -(-categories.count() // group))
    numbered = categories.withColumn("_g", F.pmod(F.xxhash64("position"), F.lit(n)))
    best = None
    for g in range(n):
        scored = chunks.join(F.broadcast(numbered.filter(F.col("_g") == g).drop("_g"))).withColumn("score", similarity)
        per = scored.groupBy("source_file").agg(F.min(F.struct((-F.col("score")).alias("apart"), "position", "name")).alias("b"))
        best = per if best is None else best.unionByName(per)
    best = best.groupBy("source_file").agg(F.min("b").alias("b"))
    return best.select("source_file", F.col("b.name").alias("category"), (-F.col("b.apart")).alias("score"))


def apply_categories(files: DataFrame, categories: DataFrame) -> DataFrame:
    """Files (path, category, ...) with the category from categories (path, category) where there is one."""
    new = categories.select("path", F.col("category").alias("_new"))
    return files.join(new, "path", "left").withColumn("category", F.coalesce("_new", "category")).drop("_new")


def merge_categories(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumnRenamed("category", "old").join(new.withColumnRenamed("category", "new"), "path", "full_outer")
    return both.select("path", F.coalesce("new", "old").alias("category"))


def distinct_moments(hits: DataFrame, bin_seconds: float = 0.01) -> DataFrame:
    """One row for moments of a source that start and end in the same bins: the best ranked one."""
    keys = [F.round(F.col(c) / bin_seconds).alias(f"_{c}") for c in ("start_time", "end_time")]
    first = F.row_number().over(W.partitionBy("source_file", *keys).orderBy("rank"))
    return hits.withColumn("_n", first).filter("_n = 1").drop("_n")


def observations(rows: DataFrame) -> DataFrame:
    """segment_id, text: of each normalized text of a segment the most confident observation, in frame order, joined by spaces.

    rows: segment_id, text, normalized, confidence, frame_ms. A segment's distinct texts are joined as one array.
    """
    best = F.row_number().over(W.partitionBy("segment_id", "normalized").orderBy(F.desc("confidence"), "frame_ms", "text"))
    kept = rows.filter(F.col("normalized") != "").withColumn("n", best).filter("n = 1")
    ordered = F.array_sort(F.collect_list(F.struct("frame_ms", "text")))
    return kept.groupBy("segment_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def table_counts(tables: dict[str, DataFrame], versions: DataFrame) -> DataFrame:
    """name, n: rows of each table, and ready versions (status) among versions."""
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    rows.append(versions.agg(F.count_if(F.col("status") == "ready").alias("n")).select(F.lit("ready_versions").alias("name"), "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def activate(aliases: DataFrame, versions: DataFrame, alias: str, version_id: object, at: object) -> DataFrame:
    """The alias log (alias, index_version_id, updated_at) with a row more; raises ValueError unless the version is ready. Rolling back is the same."""
    if versions.filter((F.col("index_version_id") == version_id) & (F.col("status") == "ready")).isEmpty():
        raise ValueError(f"version {version_id!r} is not ready")
    return aliases.unionByName(aliases.sparkSession.createDataFrame([(alias, version_id, at)], aliases.schema))


def descriptors(hits: DataFrame, media_ids: Column) -> DataFrame:
    """Hits with what a result list shows: file name, id of the medium, span as text."""
    name = F.element_at(F.split("source_file", "/"), -1)
    return hits.withColumns({"file_name": name, "media_id": media_ids, "span": F.format_string("%.1f-%.1f", "start_time", "end_time")})


def requested_sources(requested: DataFrame, indexed: DataFrame) -> DataFrame:
    """Sources asked for that are indexed, each once; missing or not, order is by name."""
    return requested.select("source_file").intersect(indexed.select("source_file")).orderBy("source_file")


def known_only(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """wanted; raises ValueError if it names a key that known lacks."""
    unknown = wanted.join(known.select(key), key, "left_anti").first()
    if unknown:
        raise ValueError(f"unknown {key}: {unknown[key]}")
    return wanted


def scan_records(records: DataFrame, wanted: DataFrame, known: DataFrame, key: str, tie: str) -> DataFrame:
    """Records of the wanted artifacts or index versions (key), numbered (place, from 1) by start_ms and tie; an unknown one is an error."""
    rows = records.join(known_only(wanted.select(key).distinct(), known, key), key, "left_semi")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("start_ms", tie)))


def artifacts_of_runs(artifacts: DataFrame, analyzer_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Artifacts (analyzer_run_id, ...) with the run_id and name of their analyzer runs (analyzer_run_id, run_id, name), of the given runs (run_id)."""
    own = analyzer_runs.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return artifacts.join(own.select("analyzer_run_id", "run_id", "name"), "analyzer_run_id")


def versions_with_definitions(versions: DataFrame, definitions: DataFrame) -> DataFrame:
    """Index versions (definition_id, ...) with the columns of their definitions (definition_id, ...)."""
    return versions.join(definitions, "definition_id")


def save_categories(categories: DataFrame, path: str) -> None:
    """Writes path -> category as a table in path order."""
    categories.select("path", "category").orderBy("path").write.mode("overwrite").parquet(path)


def load_categories(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The table written there; empty where there is none."""
    schema = "path string, category string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def modality_jobs(media: DataFrame, modalities: tuple[str, ...], key: str, runs: DataFrame) -> DataFrame:
    """media_id, modality, key, reused: a job for each medium and enabled modality, under a key of its own, so that modalities that ran already are reused.

    runs: media_id, key of completed runs.
    """
    jobs = media.select("media_id", F.explode(F.array(*(F.lit(m) for m in modalities))).alias("modality"))
    jobs = jobs.withColumn("key", F.concat(F.lit(f"{key}:"), "modality"))
    done = runs.select("media_id", "key").distinct().withColumn("done", F.lit(True))
    return jobs.join(done, ["media_id", "key"], "left").select("media_id", "modality", "key", F.coalesce("done", F.lit(False)).alias("reused"))


def overlapping(spans: DataFrame, keys: list[str], bin_seconds: float) -> DataFrame:
    """id_a < id_b, s_a, e_a, s_b, e_b: pairs of spans (keys, id, s, e) with equal keys that overlap.

    Spans are listed under the time bins they touch and joined within a bin; a pair counts in the bin of the later start only.
    """
    bins = F.sequence(F.floor(F.col("s") / bin_seconds), F.floor(F.greatest("s", "e") / bin_seconds))
    listed = spans.withColumn("bin", F.explode(bins))
    a, b = (listed.select(*keys, "bin", *(F.col(c).alias(f"{c}_{n}") for c in ("id", "s", "e"))) for n in "ab")
    pairs = a.join(b, [*keys, "bin"]).filter("id_a < id_b and s_a < e_b and s_b < e_a")
    return pairs.filter(F.floor(F.greatest("s_a", "s_b") / bin_seconds) == F.col("bin")).select("id_a", "id_b", "s_a", "e_a", "s_b", "e_b")
