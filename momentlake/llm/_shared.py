"""Shared storage for intermediate tables, and slicing of Arrow batches by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. In local mode, where it is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="momentlake-")
    return _LOCAL[spark.sparkContext.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, text_bytes: int, bucket_bytes: int = 64 << 20) -> DataFrame:
    """Writes df to the shared folder, bucketed by key, so that joins by that key do not move it again.

    Buckets hold about bucket_bytes of the text_bytes that df was made from, and are as many as shuffle partitions at least.
    The catalog's entry goes at once; the files stay in the shared folder.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // bucket_bytes))
    df.write.option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def text_bytes(docs: DataFrame) -> int:
    """Bytes of UTF-8 in the column text."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called so, letter case ignored."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"  # noqa: PLW2901
        out.append(name)
    return out


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a column's text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of text, but one whole row at least."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
