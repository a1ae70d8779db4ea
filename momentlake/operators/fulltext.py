"""Full-text search: an inverted index as tables, and BM25 over terms that must all occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.functions.text import terms
from momentlake.operators.search import rank_within
from momentlake.sources.shared import shared_path

K1, B, MOST_TERMS = 1.2, 0.75, 12


def postings(segments: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """term, id, tf, length of segments (id, text); only: the terms (term) that are wanted, others go before anything is shuffled by segment."""
    words = segments.select("id", terms(F.col("text")).alias("w"))
    each = words.select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def search(segments: DataFrame, queries: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, bm25, score (1.0): the k best segments (id, source_file, text) that hold all of a query's first 12 terms.

    Sources are applied before the cut. Only postings of the queries' terms are joined. Queries that ask for the same
    terms are answered once, and only segments that hold the rarest term of a query are scored for it.
    """
    if sources is not None:
        segments = segments.join(sources.select("source_file").distinct(), "source_file", "left_semi")
    asked = queries.select("query_id", F.array_sort(F.array_distinct(terms(F.col("text"), MOST_TERMS))).alias("w")).filter(F.size("w") > 0)
    each = asked.select("w").distinct().select("w", F.explode("w").alias("term"))
    hits, path = postings(segments, each), shared_path(segments.sparkSession, "postings")  # read three times
    hits.write.parquet(path)
    hits = segments.sparkSession.read.schema(hits.schema).parquet(path)
    corpus = segments.select(F.size(terms(F.col("text"))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_length"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rarest = each.join(df, "term").groupBy("w").agg(F.count("*").alias("known"), F.min(F.struct("df", "term")).alias("rarest")).filter(F.col("known") == F.size("w"))
    held = rarest.select("w", F.col("rarest.term").alias("term")).join(hits.select("term", "id"), "term")
    scored = held.select("w", "id", F.explode("w").alias("term")).join(hits, ["term", "id"]).join(df, "term").join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    found = scored.groupBy("w", "id").agg(F.sum(part).alias("bm25"), F.count("*").alias("n")).filter(F.col("n") == F.size("w"))
    best = rank_within(found, k, ["w"], [F.desc(F.round("bm25", 9)), F.col("id")])
    return asked.join(best, "w").select("query_id", "rank", "id", "bm25", F.lit(1.0).alias("score"))
