"""Media files as tables: scans, content hashes, the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentlake.functions.moments import file_stem
from momentlake.functions.text import category_of_path, mime_of_path

# Extensions of media files, and folders that a scan leaves out below its root.
EXTENSIONS = ("mp4", "mov", "m4v", "mkv", "avi", "webm", "wmv", "mpg", "mpeg", "3gp", "3g2", "flv", "f4v", "ogv", "vob")
SKIPPED = (".git", ".hg", ".svn", ".next", ".venv", "__pycache__", "node_modules", "target", "venv")


def is_media(path: Column) -> Column:
    """A supported extension, case ignored, after a non-empty name."""
    return F.lower(path).rlike(r"[^/]\.(" + "|".join(EXTENSIONS) + ")$")


def is_skipped(relative: Column) -> Column:
    """Whether a folder of the path below the root is one that scans leave out."""
    return F.exists(F.split(F.lower(relative), "/"), lambda part: part.isin(*SKIPPED))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def below(path: Column, root: Column) -> Column:
    return F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def media_paths(files: DataFrame, root: str) -> DataFrame:
    """The rows of files (path, ...) that a scan of root returns, with the folder part below the root tested."""
    base = root.rstrip("/") + "/"
    relative = F.substring(F.col("path"), len(base) + 1, 1 << 20)
    folders = F.regexp_replace(relative, "[^/]*$", "")
    return files.filter(F.startswith(F.col("path"), F.lit(base)) & is_media(F.col("path")) & ~is_skipped(folders))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of media files under root, by path; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(plain_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))
    return media_paths(files, plain_root(root)).orderBy("path")


def plain_root(root: str) -> str:
    return "/" + root.split(":", 1)[1].lstrip("/") if root.startswith("file:") else root


def catalog(files: DataFrame) -> DataFrame:
    """A row for each path of files (path, length, modified): names, MIME type and category by rule, in path order."""
    parts = F.split("path", "/")
    rows = files.dropDuplicates(["path"]).withColumns({
        "file_name": F.element_at(parts, -1),
        "parent_name": F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")),
        "stem": file_stem(F.col("path")),
        "mime_type": mime_of_path(F.col("path")),
        "category": category_of_path(F.col("path")),
    })
    return rows.orderBy(F.lower("path"), "path")


def united(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """The catalog of what scans of the roots return of files (path, length, modified), each file once."""
    return catalog(reduce(DataFrame.unionByName, (media_paths(files, r) for r in roots)))


def scan_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The catalog of several roots; overlapping ones give each file once."""
    return catalog(reduce(DataFrame.unionByName, (scan(spark, r) for r in roots)))


def register(files: DataFrame, media: DataFrame) -> DataFrame:
    """New media rows of files (path, content): one for each content hash that media (content_hash) lacks; the first path wins."""
    hashed = files.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("content_hash"), mime_of_path(F.col("path")).alias("mime_type"))
    first = F.row_number().over(W.partitionBy("content_hash").orderBy("uri"))
    new = hashed.withColumn("n", first).filter("n = 1").drop("n").join(media.select("content_hash"), "content_hash", "left_anti")
    return new.select(F.concat(F.lit("media_"), F.left("content_hash", F.lit(24))).alias("id"), "uri", "content_hash", "mime_type")


def missing_sources(known: DataFrame, scanned: DataFrame) -> DataFrame:
    return known.join(scanned.select(F.col("path").alias("source_file")), "source_file", "left_anti")


def owned(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files below any of the roots (root), each once: a file's folders are matched with the roots by hash."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    named = roots.select(F.regexp_replace("root", "/+$", "").alias("_root")).distinct()
    inside = files.select("path", F.explode(folders).alias("_root")).join(named, "_root", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_semi")
