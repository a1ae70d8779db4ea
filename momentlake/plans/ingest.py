"""Index builds: segments, what is left to do, embedding with retries, dead letters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.functions.moments import chunk_id, fixed_windows
from momentlake.functions.text import PERMANENT, short_error
from momentlake.functions.vectors import is_valid, l2_normalize
from momentlake.operators.records import pending

#: Texts or other payloads of one batch to vectors; raises to refuse it.
Embedder = Callable[[list], np.ndarray]


def hashing_embedder(dimension: int = 32) -> Embedder:
    """Deterministic vectors of texts: words hashed to signed buckets."""

    def embed(texts: list) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h & 1 << 31 else -1
        return out

    return embed


def segments(media: DataFrame, chunk_ms: int = 30_000, overlap_ms: int = 5_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, source_file, segment, start_time, end_time and the columns to keep of media (source_file, duration_ms)."""
    each = media.select("source_file", *keep, F.explode(fixed_windows(F.col("duration_ms"), chunk_ms, overlap_ms)).alias("w"))
    rows = each.select("source_file", F.col("w.i").alias("segment"), (F.col("w.start_ms") / 1000.0).alias("start_time"), (F.col("w.end_ms") / 1000.0).alias("end_time"), *keep)
    return rows.select(chunk_id(F.col("source_file"), F.col("start_time")).alias("id"), *rows.columns)


def permanent(error: str) -> bool:
    """Whether an error stays however often a batch is tried again; as is_permanent_failure says of columns."""
    return any(x in error.lower() for x in PERMANENT)


def embed_wanted(rows: DataFrame, payload: str, wanted: Column, embedder: Embedder, attempts: int = 3, batch: int = 64, wait: float = 0.0) -> DataFrame:
    """Rows with vector, error and attempts (null where not wanted).

    Whole batches of wanted rows first; where a batch is refused, or answered with another number of vectors, its rows
    one by one, each up to `attempts` times, but once where its error is permanent. wait: seconds before the second
    attempt, doubled before each later one, at most 32 times that.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def vectors(values: list) -> list[list[float]]:
        out = [np.asarray(v, float).tolist() for v in embedder(values)]
        if len(out) != len(values):
            raise ValueError(f"the embedder returned {len(out)} vectors for {len(values)}")
        return out

    def one(value: object) -> tuple[list | None, str | None, int]:
        for k in range(1, max(attempts, 1) + 1):
            try:
                return vectors([value])[0], None, k
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if permanent(error) or isinstance(e, FileNotFoundError):
                    break
                time.sleep(wait * 2 ** min(k - 1, 5) if k < attempts else 0)
        return None, error, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = [(None, None, None)] * b.num_rows
            asked = np.flatnonzero(b["_wanted"].to_numpy(zero_copy_only=False)).tolist()
            values = b[payload].take(pa.array(asked, pa.int64())).to_pylist()
            for k in range(0, len(asked), batch):
                some = values[k : k + batch]
                try:
                    done = [(v, None, 1) for v in vectors(some)]
                except Exception:  # noqa: BLE001
                    done = [one(v) for v in some]
                for i, x in zip(asked[k : k + batch], done, strict=True):
                    out[i] = x
            vector, error, tries = zip(*out, strict=True) if out else ((), (), ())
            own = b.drop_columns(["_wanted"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(vector, pa.list_(pa.float64())), pa.array(error, pa.string()), pa.array(tries, pa.int64())], [*own.schema.names, "vector", "error", "attempts"])

    return rows.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).mapInArrow(run, f"{fields}, vector array<double>, error string, attempts long")


def embed(rows: DataFrame, payload: str, embedder: Embedder, attempts: int = 3, batch: int = 64) -> DataFrame:
    """embed_wanted() for all rows."""
    return embed_wanted(rows, payload, F.lit(True), embedder, attempts, batch)


@dataclass
class Build:
    chunks: DataFrame
    failed: DataFrame


def build(expected: DataFrame, stored: DataFrame, failed: DataFrame, embedder: Embedder, dimension: int, payload: str = "payload", retry_failed: bool = False) -> Build:
    """New chunks and dead letters for expected (id, source_file, start_time, end_time, payload); known and failed ids are left out."""
    todo = pending(expected, stored, failed, retry_failed)
    done = embed(todo, payload, embedder)
    good = F.col("error").isNull() & is_valid(F.col("vector"), dimension)
    chunks = done.filter(good).select("id", "source_file", "start_time", "end_time", l2_normalize(F.col("vector")).alias("embedding"))
    bad = done.filter(~good).select("id", "source_file", "start_time", "end_time", short_error(F.coalesce("error", F.lit("invalid vector"))).alias("error"), "attempts")
    return Build(chunks, bad)


def dead_letters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with the error, attempts and last attempt of new ones that share their id (spans stay as they were), and the other new ones."""
    fresh = [c for c in ("error", "attempts", "last_attempt") if c in old.columns]
    later = new.select("id", *(F.col(c).alias(f"_{c}") for c in fresh))
    kept = old.join(later, "id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fresh else F.col(c) for c in old.columns))
    return kept.unionByName(new.join(old.select("id"), "id", "left_anti").select(*old.columns))


def check_compatible(stored: DataFrame, backend: str, model: str) -> None:
    """Raises ValueError if a store holds vectors of another backend or model."""
    other = stored.select("backend", "model").distinct().filter((F.col("backend") != backend) | (F.col("model") != model)).first()
    if other:
        raise ValueError(f"the store holds vectors of {other.backend}/{other.model}")


def list_dead_letters(letters: DataFrame) -> DataFrame:
    """By last attempt, then id."""
    return letters.orderBy("last_attempt", "id")


def without_dead_letters(letters: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left when the letters of ids (id) are removed."""
    return letters.join(ids.select("id"), "id", "left_anti")
