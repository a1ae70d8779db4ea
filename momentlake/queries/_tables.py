"""What the queries take for chunks, spans and JSON records: derived from the driver's tables by Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 30 s every 25 s of 37 sources, from embeddings."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("c%08d", v).alias("id"),
        F.format_string("/lib/%02d.mp4", v % 37).alias("source_file"),
        (F.floor(v / 37) * 25.0).alias("start_time"),
        (F.floor(v / 37) * 25.0 + 30.0).alias("end_time"),
        "embedding",
        "vec_id",
        "label",
    )


CHUNKS = """chunks AS (SELECT printf('c%08d', vec_id) AS id, printf('/lib/%02d.mp4', vec_id % 37) AS source_file, (vec_id // 37) * 25.0::DOUBLE AS start_time,
  (vec_id // 37) * 25.0::DOUBLE + 30.0 AS end_time, embedding::DOUBLE[] AS v, vec_id, label FROM embeddings)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, as a query."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


ASKED = "asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0)"


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records from events: type, k (left out for every seventh user), tags, detail.value."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    detail = F.struct(F.round("value", 2).alias("value"), F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("kind"))
    data = F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("user_id") % 7 != 0, F.col("k")).alias("k"), F.array("event_type", F.format_string("u%d", F.col("user_id") % 5)).alias("tags"), detail.alias("detail")))
    start = (F.unix_micros("ts") / 1000).cast("long")
    return e.select(F.col("event_id").alias("record_id"), start.alias("start_ms"), (start + 1000).alias("end_ms"), F.col("user_id").alias("media_id"), "event_type", F.parse_json(data).alias("data"))


RECORDS = """records AS (SELECT event_id AS record_id, epoch_us(ts) // 1000 AS start_ms, user_id AS media_id, event_type AS type,
  CASE WHEN user_id % 7 <> 0 THEN json_extract_string(props, '$.k')::INT END AS k, [event_type, 'u' || (user_id % 5)] AS tags,
  round(value, 2) AS value, CASE WHEN user_id % 3 = 0 THEN event_type END AS kind FROM events)"""
