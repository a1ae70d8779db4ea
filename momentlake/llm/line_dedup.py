"""Line dedup by overlapping three-line windows [native].

Each run of `window` consecutive lines is hashed (128 bits); of equal windows anywhere in the table the
first, by doc_id and position, stays, and the lines under all later ones go, overlapping ones merged.

Defined cases: a null text stays null with no lines; texts of fewer lines than a window, and windows of
blank lines only, never match; rows with one doc_id and different texts count as different documents, in
the order of their text's hash; identical rows get identical results and do not remove one another; other
columns stay whatever their names are, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import unused


def _windows(lines: Column, size: int) -> Column:
    def at(i: Column) -> Column:
        parts = [F.element_at(lines, (i + k).cast("int")) for k in range(size)]
        blank = F.length(F.trim(F.concat(*parts))) == 0
        return F.struct(
            i.cast("int").alias("pos"),
            F.when(~blank, F.xxhash64(F.lit(1), *parts)).alias("h1"),
            F.xxhash64(F.lit(2), *parts).alias("h2"),
        )

    return F.when(F.size(lines) >= size, F.transform(F.sequence(F.lit(1), F.size(lines) - size + 1), at))


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, text and any further columns of docs, with text cut; adds n_lines and n_removed (long), replacing columns so named."""
    docs = docs.drop("n_lines", "n_removed")
    th, cut, id_, h, places, left = unused(docs.columns, "text_hash", "lines", "id", "h", "places", "left")
    rows = docs.withColumn(th, F.xxhash64("text")).withColumn(cut, F.split("text", "\n", -1))
    windows = (
        rows.select("doc_id", th, F.explode(_windows(F.col(cut), window)).alias("w"))
        .select("doc_id", th, "w.pos", "w.h1", "w.h2")
        .filter("h1 is not null")
    )
    at = F.struct("doc_id", th, "pos")
    firsts = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(firsts, ["h1", "h2"]).filter(at > F.col("first"))
    covered = later.groupBy(F.col("doc_id").alias(id_), F.col(th).alias(h)).agg(F.collect_set("pos").alias(places))
    joined = rows.join(covered, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(h)), "left")
    gone = F.flatten(F.transform(places, lambda p: F.sequence(p, p + window - 1)))
    kept = F.array_except(F.sequence(F.lit(1), F.size(cut)), gone)
    return (
        joined.withColumn(left, F.when(F.col(places).isNotNull(), kept))
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(cut)).cast("long"))
        .withColumn("n_removed", F.when(F.col(left).isNull(), 0).otherwise(F.col("n_lines") - F.size(left)).cast("long"))
        .withColumn(
            "text",
            F.when(F.col(left).isNull(), F.col("text")).otherwise(
                F.array_join(F.transform(left, lambda i: F.element_at(cut, i)), "\n")
            ),
        )
        .select(*docs.columns, "n_lines", "n_removed")
    )
