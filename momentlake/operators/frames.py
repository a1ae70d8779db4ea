"""Features of RGB frames (span_id, frame_idx, width, height, rgb) and of query texts, in one space of 124 numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS = (64, 48, 8, 4)  # colours 4 x 4 x 4, a grid of 4 x 4 mean colours, brightness, motion
LEAST_CHANGE = 2.5  # fixed value: mean difference of a changed frame
MOTION_EDGES = (0.01, 0.05, 0.15)  # fixed value: shares of changed brightness

# RGB quarters of colour words, and the words for brightness and motion.
COLOURS = {
    "red": (3, 0, 0), "green": (0, 3, 0), "blue": (0, 0, 3), "yellow": (3, 3, 0), "cyan": (0, 3, 3), "magenta": (3, 0, 3), "purple": (3, 0, 3),
    "violet": (3, 0, 3), "orange": (3, 2, 0), "pink": (3, 1, 2), "brown": (2, 1, 0), "white": (3, 3, 3), "black": (0, 0, 0), "gray": (1, 1, 1), "grey": (1, 1, 1),
}
DARK = ("dark", "black", "night", "dim", "shadow", "shadowy")
BRIGHT = ("bright", "white", "light", "day", "sunny", "daytime")
FAST = ("moving", "move", "fast", "running", "run", "driving", "drive", "action", "motion")
STILL = ("parked", "still", "static", "idle", "stopped", "stationary")


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(-1, keepdims=True))
    return v / np.where(n > 1e-12, n, 1)


def frame_parts(width: int, height: int, rgb: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Colour histogram, grid of mean colours and mean luminance of a frame."""
    px = np.frombuffer(rgb or b"", np.uint8)
    px = px[: len(px) // 3 * 3].reshape(-1, 3).astype(np.int64)
    q = px // 64
    hist = np.bincount(q[:, 0] * 16 + q[:, 1] * 4 + q[:, 2], minlength=64).astype(float)
    i = np.arange(len(px))
    cell = np.minimum(i // width // -(-height // 4), 3) * 4 + np.minimum(i % width // -(-width // 4), 3)
    n = np.maximum(np.bincount(cell, minlength=16), 1)
    grid = np.stack([np.bincount(cell, px[:, c] / 255, 16) / n for c in range(3)], 1).ravel()
    return hist, grid, float((px @ np.array([0.299, 0.587, 0.114])).mean() / 255) if len(px) else 0.0


def difference(a: bytes | None, b: bytes | None) -> float:
    """Mean absolute difference of the channels of two frames, in [0, 1]; a null frame is an empty one."""
    x, y = np.frombuffer(a or b"", np.uint8), np.frombuffer(b or b"", np.uint8)
    n = min(len(x), len(y))
    return float(np.abs(x[:n].astype(int) - y[:n].astype(int)).mean() / 255) if n else 0.0


def frame_differences(frames: DataFrame) -> DataFrame:
    """span_id, frame_idx, difference to the frame before it (null for a span's first one)."""
    diff = F.pandas_udf(lambda a, b: pd.Series([None if x is None else difference(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    before = F.lag("rgb").over(W.partitionBy("span_id").orderBy("frame_idx"))
    return frames.withColumn("before", before).select("span_id", "frame_idx", diff("before", "rgb").alias("difference"))


def span_features(frames: DataFrame) -> DataFrame:
    """span_id, embedding: block-normalized features of a span. Frames become 114 numbers each before a span's come together."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [frame_parts(w, h, rgb) for w, h, rgb in zip(b["width"].to_pylist(), b["height"].to_pylist(), b["rgb"].to_pylist(), strict=True)]
            moved = [None if x is None else difference(x, y) for x, y in zip(b["before"].to_pylist(), b["rgb"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"span_id": b["span_id"], "hist": [f[0] for f in found], "grid": [f[1] for f in found], "luma": [f[2] for f in found], "difference": pa.array(moved, pa.float64())})

    def features(t: pa.Table) -> pa.Table:
        hist, grid = (np.array(t[c].to_pylist()).mean(0) for c in ("hist", "grid"))
        bright = np.bincount(np.minimum(t["luma"].to_numpy() * 8, 7).astype(int), minlength=8) / t.num_rows
        moved = t["difference"].drop_null().to_numpy()
        motion = np.bincount(np.searchsorted(MOTION_EDGES, moved, "right"), minlength=4) / max(1, len(moved))
        return pa.table({"span_id": t["span_id"][:1], "embedding": [unit(np.concatenate([unit(x) for x in (hist, grid, bright, motion)]))]})

    before = F.lag("rgb").over(W.partitionBy("span_id").orderBy("frame_idx"))
    each = frames.withColumn("before", before).select("span_id", "width", "height", "rgb", "before")
    each = each.mapInArrow(parts, "span_id long, hist array<double>, grid array<double>, luma double, difference double")
    return each.groupBy("span_id").applyInArrow(features, "span_id long, embedding array<double>")


def text_features(queries: DataFrame) -> DataFrame:
    """query_id, embedding of queries (query_id, text): colour, brightness and motion words in the space of span_features."""

    def bump(block: np.ndarray, at: int) -> None:
        block[at] += 1
        block[[k for k in (at - 1, at + 1) if 0 <= k < len(block)]] += 0.5

    def features(text: str) -> np.ndarray:
        words = set("".join(c if c.isalnum() else " " for c in text.lower()).split())
        tokens = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        cube, bright, motion = np.zeros((4, 4, 4)), np.zeros(8), np.zeros(4)
        for t in tokens:
            if t in COLOURS:
                centre = np.array(COLOURS[t])
                cube[tuple(centre)] += 1
                for step in (*np.eye(3, dtype=int), *-np.eye(3, dtype=int)):
                    if ((centre + step >= 0) & (centre + step < 4)).all():
                        cube[tuple(centre + step)] += 0.5
        for hit, block, at in ((DARK, bright, 0), (BRIGHT, bright, 7), (FAST, motion, 3), (STILL, motion, 0)):
            if words & set(hit):
                bump(block, at)
        return unit(np.concatenate([unit(cube.ravel()), np.zeros(48), unit(bright), unit(motion)]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"query_id": b["query_id"], "embedding": [features(t or "") for t in b["text"].to_pylist()]})

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(each, "query_id long, embedding array<double>")


def changed_frames(frames: DataFrame, least: float = LEAST_CHANGE) -> DataFrame:
    """Frames that differ from the last kept one of their span by `least` (mean of 0 to 255) at least; a span's first one stays."""

    def keep(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame_idx")
        kept, last = [], None
        for i, rgb in enumerate(t["rgb"].to_pylist()):
            if last is None or difference(last, rgb) * 255 >= least:
                kept.append(i)
                last = rgb
        return t.take(pa.array(kept, pa.int64()))

    return frames.groupBy("span_id").applyInArrow(keep, frames.schema)
