"""Questions of text chunks to hash buckets, and the answers brought back to the chunks.

A chunk asks every bucket about its own fingerprints that fall into it, packed into one row; a bucket sees the
fingerprints of all chunks at once and answers each chunk with one row. So a corpus-wide lookup of billions of
fingerprints moves as binary rows instead of a row each, and buckets are even whatever repeats. There is a row for each
chunk and bucket that meet: chunks of some megabytes and buckets of a million entries keep them large as long as the
corpus has less than about a million times a million entries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import stage
from momentlake.llm._words import U


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(data: bytes, kind: np.dtype | type | str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def cuts(n: int) -> np.ndarray:
    """First fingerprint of each of n equal ranges of 64-bit fingerprints."""
    return np.array([-(-(k << 64) // n) for k in range(n)], U)


def answered(questions: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
    """questions: rows with a column bucket; answer: of one bucket's rows. The answers are written as a table."""
    return stage(questions.groupBy("bucket").applyInArrow(answer, schema), name)


def with_answers(chunks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Chunks with an array of (bucket, answer), in the order of buckets, in column; null without answers."""
    own = answers.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias(column))
    return chunks.join(own, "chunk_id", "left")
