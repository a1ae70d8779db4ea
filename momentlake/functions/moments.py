"""Time spans: segmentation, sample times, identifiers, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_windows(duration_ms: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """Array of (i, start_ms, end_ms): windows of chunk_ms every chunk_ms - overlap_ms, the last one clamped."""
    if overlap_ms >= chunk_ms:
        raise ValueError("overlap must be shorter than the chunk")
    step = chunk_ms - overlap_ms
    n = F.greatest(F.lit(1), F.ceil((duration_ms - overlap_ms) / step)).cast("long")

    def window(i: Column) -> Column:
        start = i * step
        return F.struct(i.alias("i"), start.alias("start_ms"), F.least(start + chunk_ms, duration_ms).alias("end_ms"))

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), window)


def midpoint_times(duration: Column, n: Column) -> Column:
    """(i + 1/2) / n of the duration, for each of n frames."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (i + 0.5) / n)


def interior_times(duration: Column, n: Column) -> Column:
    """(i + 1) / (n + 1) of the duration, for each of n frames."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (i + 1) / (n + 1))


def segment_id(i: Column) -> Column:
    return F.format_string("segment_%06d", i)


def number_text(x: Column) -> Column:
    """A double without a trailing .0, as in 25 or 2.5."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def chunk_id(source: Column, start: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of source:start."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), number_text(start)), 256), 1, 16)


def format_duration(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour, rounded to seconds; negative counts as 0."""
    s = F.round(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def format_bytes(n: Column) -> Column:
    """Bytes by powers of 1024 up to GB, with one decimal (halves to the even one); whole bytes below."""
    out = F.format_string("%.1f GB", F.bround(n / 1024.0**3, 1))
    for unit, power in (("MB", 2), ("KB", 1)):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def clip_time(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    return F.format_string("%02dm%02ds", F.floor(s / 60), s % 60)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def clip_name(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("match_"), file_stem(path), F.lit("_"), clip_time(start), F.lit("-"), clip_time(end), F.lit(".mp4"))


def clip_start(start: Column, pad: float = 2.0) -> Column:
    return F.greatest(start - pad, F.lit(0.0))


def clip_end(end: Column, duration: Column, pad: float = 2.0) -> Column:
    return F.least(end + pad, duration)


def valid_interval(start: Column, end: Column) -> Column:
    """start >= 0 and end > start, both finite."""
    finite = ~(F.isnan(start.cast("double")) | F.isnan(end.cast("double"))) & (F.abs(end.cast("double")) < float("inf"))
    return F.coalesce((start >= 0) & (end > start) & finite, F.lit(False))


def overlap_ratio(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Length of the overlap, as a part of the shorter span (at least 0.001)."""
    overlap = F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0.0))
    return overlap / F.greatest(F.least(end - start, other_end - other_start), F.lit(0.001))


def _frame_span(n_frames: Column, fps: Column, most: int, start: Column | None, end: Column | None) -> tuple[Column, Column, Column]:
    """First and last frame of a span (seconds), and how many of them spaced_frames() takes."""
    rate = F.greatest(fps, F.lit(0.001))
    first = F.lit(0) if start is None else F.least(n_frames - 1, F.greatest(F.lit(0), (start * rate).cast("int")))
    last = n_frames - 1 if end is None else F.least(n_frames - 1, F.greatest(first, (end * rate).cast("int") - 1))
    return first, last, F.least(F.lit(most), last - first + 1)


def spaced_frames(n_frames: Column, fps: Column, most: int, start: Column | None = None, end: Column | None = None) -> Column:
    """At most `most` evenly spaced frame numbers of a span (seconds), both ends included; null where there are no frames."""
    first, last, count = _frame_span(n_frames, fps, most, start, end)
    step = (last - first) / F.greatest(count - 1, F.lit(1))
    span = F.array(F.struct(first.alias("first"), count.alias("count"), step.alias("step")))  # once a span, not once a frame
    spaced = F.transform(span, lambda s: F.transform(F.sequence(F.lit(0), s["count"] - 1), lambda i: (s["first"] + i * s["step"]).cast("int")))[0]
    return F.when(n_frames > 0, spaced)


def spaced_count(n_frames: Column, fps: Column, most: int, start: Column | None = None, end: Column | None = None) -> Column:
    """The number of spaced_frames(), without making them."""
    return F.when(n_frames > 0, _frame_span(n_frames, fps, most, start, end)[2])


def first_segments(spans: Column, most: int | None) -> Column:
    """The first `most` spans of an array, all of them for null."""
    return spans if most is None else F.slice(spans, 1, most)
