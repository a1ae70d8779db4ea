"""The corpus pipeline: documents without toxic ones, repeated lines, near copies and benchmark leaks, packed to sequences.

Every stage but the last returns the columns of documents (doc_id, text and any others, whatever their names are).
Near copies are documents that share 80 % of their five-word shingles or more: the setting for stages on word
shingles. It is stricter than that of op5_near_dedup, which links two-word shingles by its contract.

Defined cases: null and empty texts pass all stages (they are the end id alone in the last one); rows with a null
doc_id are never near copies; rows that repeat a doc_id are one document for the near-copy stage, and stay or go
together; an empty table gives no rows. The last stage returns a row for each piece: doc_id, piece, start, length,
ids_crc32, ids (its token ids), sequence_id, offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from momentlake.llm._shared import crc_mod, stage


def _guarded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work's rows with the columns of docs; it sees doc_id and text by name and the others under names of no operator."""
    aside = {c: f"column {i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(F.col("doc_id"), 4) != 2)
    model = toxicity.train(docs, labels)
    return _guarded(docs, lambda rows: toxicity.score(rows, model).filter("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _guarded(docs, line_dedup.dedup_lines)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    return docs.join(groups.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _guarded(docs, lambda rows: decontaminate.find_leaks(rows, benchmark).filter(F.size("leaks") == 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, with_ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: A learned classifier comes first, so SQL cannot express the rows; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as a table in the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
