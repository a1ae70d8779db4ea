"""Exact substring dedup: blockwise suffix sorting behind difference-cover samples.

A byte goes if some `window`-byte string over it also starts earlier, in a smaller doc_id or earlier in its
own document. Documents are bytes in UTF-8; strings never cross documents.

1. Documents are packed into chunks. Copies of a whole document go at once; they need no further look.
2. Which suffixes need sorting: cover samples are positions of a document whose offset modulo PERIOD lies in a
   difference cover. For any two positions there is an offset below PERIOD that leads both to samples, so two
   equal windows always hold a pair of equal samples, strings of window - PERIOD + 1 bytes, at the same place.
   Fingerprints of samples are compared in buckets; only suffixes with a sample less than PERIOD bytes ahead
   that has a twin are sorted. A collision of fingerprints only adds a suffix to the sort.
3. Suffixes fall into buckets by content: by the least hash of the short strings in their window, so equal
   windows share a bucket, and runs of neighbouring suffixes travel as one string of bytes. One bucket is
   sorted at a time: its cover samples are ranked first, then its suffixes are sorted by their first bytes, as
   far as the cover may reach, and the ties left are parted by the ranks of the samples that the cover names
   for each pair. Neighbours in that order are compared byte by byte; where `window` bytes agree, all but the
   one that starts first are repeats.
4. The verdicts go back to the chunks, where the windows of such suffixes are merged to spans.

A chunk sends each distinct string once, at its first place in the chunk; its later places in the chunk are
repeats at once. Suffixes that reach into a passage which many documents share have one least hash, each in a context
of its own: a bucket of over LARGE times its share is split suffix by suffix, by the hash of the whole window, so that
equal windows stay together and others part. A task holds one chunk, bucket or part; a window adds one entry a chunk
to its part at most, however often it occurs. No result rests on a hash.

Defined cases: a null or empty text has no bytes and loses none; a null doc_id comes before all others;
rows with one doc_id and different texts go by the digest of the text; identical rows (doc_id and text) are
one document and get identical results; texts shorter than the window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm._exchange import answered, expand, squeeze, with_answers
from momentlake.llm._shared import bucketed, stage, text_bytes, text_slices
from momentlake.llm._words import U, buffers, mix, powers, prefix_sums, span_hash

PERIOD = 57
COVER = np.array([1, 6, 7, 9, 19, 38, 42, 49])  # every difference modulo 57 occurs
MERS = 16
MOST = 156  # windows of one string
LARGE = 4  # times its share of suffixes, and a bucket is split
DEPTH = PERIOD // 8 * 8  # bytes sorted before ranks decide: no offset of the cover is larger
_LEAD = np.array([[min(d for d in range(PERIOD) if {(a + d) % PERIOD, (b + d) % PERIOD} <= set(COVER.tolist())) for b in range(PERIOD)] for a in range(PERIOD)])
GAP = 8  # zero bytes behind each string, so that a word read at its last byte stays inside
_FIRST = -(1 << 63)


def pack(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of documents: ids, sizes, digests and the bytes, compressed."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in text_slices(batches, "text", chunk_bytes):
            data, offsets = buffers(b["text"])
            digests = [hashlib.sha256(data[s:e]).digest()[:16] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"chunk_id": [base + n], "doc_ids": pa.array([b["doc_id"].to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([np.diff(offsets)], pa.list_(pa.int64())), "digests": pa.array([digests], pa.list_(pa.binary())), "data": [squeeze(data)]})
            n += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(chunks, "chunk_id long, doc_ids array<long>, sizes array<long>, digests array<binary>, data binary")


def copies(chunks: DataFrame, window: int) -> DataFrame:
    """chunk_id and the places in it of documents whose whole text an earlier document has."""
    each = chunks.select("chunk_id", F.posexplode(F.arrays_zip("doc_ids", "sizes", "digests")).alias("place", "d"))
    each = each.select("chunk_id", "place", F.coalesce("d.doc_ids", F.lit(_FIRST)).alias("doc_id"), "d.digests").filter(F.col("d.sizes") >= window)
    # one row for each text of a chunk, before anything is shuffled: chunks are bucketed by their id
    each = each.groupBy("chunk_id", "digests").agg(F.collect_list(F.struct("doc_id", "place")).alias("docs"), F.min("doc_id").alias("least"))
    first = each.groupBy("digests").agg(F.min("least").alias("first"), F.sum(F.size("docs")).alias("n")).filter("n > 1").drop("n")
    later = each.join(first, "digests").select("chunk_id", "first", F.inline("docs")).filter("doc_id > first")
    return later.groupBy("chunk_id").agg(F.collect_list("place").alias("copies"))


class Chunk:
    """A chunk's bytes and the documents in it that are looked at: no copies, none shorter than the window."""

    def __init__(self, row: dict, window: int) -> None:
        self.data = expand(row["data"], np.uint8)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.copy = np.zeros(len(self.sizes), bool)
        self.copy[row["copies"] or []] = True
        self.row, self.window = row, window
        self.own = np.flatnonzero(~self.copy & (self.sizes >= window))
        self.sums = prefix_sums(self.data)

    def samples(self) -> np.ndarray:
        reach = self.window - PERIOD + 1
        most = int(self.sizes[self.own].max(initial=0))
        cover = (np.arange(most // PERIOD + 1)[:, None] * PERIOD + COVER).ravel()
        parts = [self.starts[d] + cover[: np.searchsorted(cover, self.sizes[d] - reach, "right")] for d in self.own.tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def sample_hashes(self, at: np.ndarray) -> np.ndarray:
        return span_hash(self.sums, at, at + self.window - PERIOD + 1)

    def candidates(self, samples: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Suffixes that have a tied sample less than PERIOD ahead and a whole window in their document."""
        seen = np.zeros(len(self.data) + PERIOD + 1, np.int32)
        seen[samples[tied] + 1] = 1
        np.cumsum(seen, out=seen)
        able = seen[PERIOD : PERIOD + len(self.data)] > seen[: len(self.data)]
        inside = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(inside, self.starts[self.own], 1)
        np.add.at(inside, self.starts[self.own] + self.sizes[self.own] - self.window + 1, -1)
        return np.flatnonzero(able & (np.cumsum(inside[:-1]) > 0))

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring suffixes whose windows have one least hash: first place, number of suffixes, that hash."""
        if not len(at):
            return at, at, np.zeros(0, U)
        mers = min(MERS, self.window)
        starts = np.arange(len(self.data) - mers + 1)
        low, width, span = span_hash(self.sums, starts, starts + mers), 1, self.window - mers + 1
        while width < span:
            step = min(width, span - width)
            low, width = np.minimum(low[:-step], low[step:]), width + step
        low = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (low[1:] != low[:-1])
        new |= (np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % MOST == 0
        heads = np.flatnonzero(new)
        return at[heads], np.diff(heads, append=len(at)), mix(low[heads])

    def distinct(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of strings: the earliest of each text, each one's number among these, whether it starts later than that; the texts."""
        ids = np.array([_FIRST if i is None else i for i in self.row["doc_ids"]], np.int64)
        ties = np.array([int.from_bytes(d[:8], "little", signed=True) for d in self.row["digests"]], np.int64)
        rank = _ranks(ids, ties)
        doc = np.searchsorted(self.starts, at, "right") - 1
        offset, rank = at - self.starts[doc], rank[doc]
        raw, number, first, known = self.data.tobytes(), np.zeros(len(at), np.int64), [], {}
        ends = (at + sizes + self.window - 1).tolist()
        starts = at.tolist()
        for k in np.lexsort((offset, rank)).tolist():
            number[k] = n = known.setdefault(raw[starts[k] : ends[k]], len(known))
            if n == len(first):
                first.append(k)
        first = np.array(first, np.int64)
        lead = first[number]
        return first, number, (rank > rank[lead]) | ((rank == rank[lead]) & (offset > offset[lead])), list(known)


def _ranks(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Order of documents by id, then digest; identical ones share a place."""
    by_place = np.lexsort((ties, ids))
    rank = np.zeros(len(ids), np.int64)
    rank[by_place[1:]] = np.cumsum((np.diff(ids[by_place]) != 0) | (np.diff(ties[by_place]) != 0))
    return rank


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _part(order: np.ndarray, new: np.ndarray, at: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Sorts the items at these places of an order inside their groups by a key of so many bits, and parts the groups; the places' new order."""
    code = np.cumsum(new)[at] << bits | key
    by = np.argsort(code)
    order[at], code = order[at[by]], code[by]
    new[at[1:]] |= code[1:] != code[:-1]
    return by


def _tied(new: np.ndarray, done: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~(new & np.append(new[1:], True)) & ~done)


def _one_group(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.zeros(n, bool)
    new[:1] = True
    return np.arange(n), new, np.zeros(n, bool)


def sorted_suffixes(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of `window` bytes at least, numbered string by string; which share `window` bytes with the one before.

    The order is lexicographic by bytes; a suffix ends with its string.
    """
    data = np.frombuffer(bytes(GAP).join([*strings, b""]), np.uint8)
    lengths = np.fromiter((len(x) for x in strings), np.int64, len(strings))
    starts = np.cumsum(lengths + GAP) - lengths - GAP
    at = np.repeat(starts, lengths - window + 1) + _steps(lengths - window + 1)
    w = np.append(data, np.zeros(8, np.uint8)).astype(U)
    for k in (1, 2, 4):
        w = (w[:-k] << U(8 * k)) | w[k:]
    w = np.unique(w[: len(data)], return_inverse=True)[1]  # of each place's eight bytes, the rank
    bits = len(data).bit_length()
    spot = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(data)) % PERIOD])
    own = np.searchsorted(starts, spot, "right") - 1
    left = starts[own] + lengths[own] - spot
    spot, left = spot[left > 0], left[left > 0]
    order, new, done = _one_group(len(spot))
    depth = 0
    while len(tied := _tied(new, done)):
        own = order[tied]
        there = np.clip(left[own] - depth, 0, 8)
        by = _part(order, new, tied, w[spot[own] + depth] << 4 | there, bits + 4)
        done[tied] = there[by] < 8  # noqa: PLR2004
        depth += 8
    rank = np.zeros(len(data), np.int64)
    rank[spot[order]] = np.cumsum(new)

    order, new, done = _one_group(len(at))
    for depth in range(0, DEPTH, 8):
        if len(tied := _tied(new, done)):
            _part(order, new, tied, w[at[order[tied]] + depth], bits)
    near = ~new
    while len(tied := _tied(new, done)):
        heads = np.flatnonzero(new)
        pivot = at[order[heads + np.diff(heads, append=len(at)) // 2]][np.cumsum(new)[tied] - 1]
        own = at[order[tied]]
        lead = _LEAD[own % PERIOD, pivot % PERIOD]
        side = np.sign(rank[own + lead] - rank[pivot + lead])
        by = _part(order, new, tied, side + 1, 2)
        done[tied] = side[by] == 0
    pairs = np.flatnonzero(near)
    one, two = at[order[pairs - 1]], at[order[pairs]]
    alike = np.ones(len(pairs), bool)
    for depth in [*range(DEPTH, window - 8, 8), window - 8]:
        alike &= w[one + depth] == w[two + depth]
    same = np.zeros(len(at), bool)
    same[pairs] = alike
    return order, same


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, then place; the buckets there are, and where each begins in that order (and the end)."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    return order, there, np.append(first, len(bucket))


def _bits(replies: list[dict] | None, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(starts).tolist()
    parts = [np.unpackbits(np.frombuffer(r["answer"], np.uint8), count=n) for r, n in zip(replies or [], sizes, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _tied_samples(c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    at = c.samples()
    h, number = np.unique(c.sample_hashes(at), return_inverse=True)
    order, _, starts = _by_bucket(_bucket(h, buckets))
    tied = np.zeros(len(h), bool)
    tied[order] = _bits(c.row["ranks"], starts)
    return at, tied[number]


def rank_samples(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """Per chunk and bucket, a bit for each of the chunk's distinct samples: tied or one of a kind; ties: how many places are tied."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, window)
                h, counts = np.unique(c.sample_hashes(c.samples()), return_counts=True)
                order, there, starts = _by_bucket(_bucket(h, buckets))
                keys = h[order].view(np.uint8).reshape(-1, 8)[:, :5]  # with the bucket's, bits enough
                blobs = [keys[s:e].tobytes() for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                counts = counts[order].astype("<u4")
                places = [counts[s:e].tobytes() for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([row["chunk_id"]] * len(there), pa.int64()), pa.array(blobs, pa.binary()), pa.array(places, pa.binary())], ["bucket", "chunk_id", "keys", "places"])

    def rank(t: pa.Table) -> pa.Table:
        sizes = [len(x.as_py()) // 5 for x in t["keys"]]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :5] = np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint8).reshape(-1, 5)
        keys = keys.view("<u8").ravel()
        order = np.argsort(keys)
        same = np.concatenate([[False], keys[order[1:]] == keys[order[:-1]], [False]])
        places = np.frombuffer(b"".join(t["places"].to_pylist()), "<u4")
        tied = places > 1
        tied[order] |= same[1:] | same[:-1]
        parts, own = (np.split(x, np.cumsum(sizes)[:-1]) for x in (tied, np.where(tied, places, 0)))
        return pa.table({"bucket": t["bucket"], "chunk_id": t["chunk_id"], "answer": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary()), "ties": pa.array([int(x.sum(dtype=np.int64)) for x in own], pa.int64())})

    asked = chunks.mapInArrow(ask, "bucket long, chunk_id long, keys binary, places binary")
    return answered(asked, rank, "bucket long, chunk_id long, answer binary, ties long", "ranks")


_ASKED = "bucket long, chunk_id long, n long, data binary, places binary"


def _asked(chunks: DataFrame, window: int, buckets: int, suffix_buckets: int) -> DataFrame:
    """The chunks' distinct strings by bucket: their bytes, and of each doc_id, tie, offset and number of suffixes (n in all)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, window)
                at = c.candidates(*_tied_samples(c, buckets))
                at, sizes, low = c.strings(at)
                first, _, _, texts = c.distinct(at, sizes)
                at, sizes = at[first], sizes[first]
                order, there, starts = _by_bucket(_bucket(low[first], suffix_buckets))
                doc = np.searchsorted(c.starts, at, "right") - 1
                ids = np.array([_FIRST if i is None else i for i in row["doc_ids"]], np.int64)[doc]
                ties = np.array([int.from_bytes(d[:8], "little", signed=True) for d in row["digests"]], np.int64)[doc]
                places = np.stack([ids, ties, at - c.starts[doc], sizes], 1)
                own = [x for x in np.split(order, starts[1:-1]) if len(x)]
                yield _rows(there, row["chunk_id"], [(b"".join([texts[k] for k in x.tolist()]), places[x]) for x in own])

    return chunks.mapInArrow(ask, _ASKED)


def _rows(buckets: np.ndarray, chunk: int, own: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    n = pa.array([int(p[:, 3].sum()) for _, p in own], pa.int64())
    data, places = pa.array([squeeze(np.frombuffer(d, np.uint8)) for d, _ in own], pa.binary()), pa.array([squeeze(p) for _, p in own], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([chunk] * len(own), pa.int64()), n, data, places], ["bucket", "chunk_id", "n", "data", "places"])


def _windows(row: dict, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of _asked(): its bytes, where each suffix starts in them, its place, and the part that its window's hash names."""
    data, places = expand(row["data"], np.uint8), expand(row["places"], np.int64).reshape(-1, 4)
    sizes = places[:, 3]
    lengths, steps = sizes + window - 1, _steps(sizes)
    at = np.repeat(np.cumsum(lengths) - lengths, sizes) + steps
    own = np.repeat(places, sizes, axis=0)
    own[:, 2] += steps
    own[:, 3] = 1
    return data, at, own, _bucket(span_hash(prefix_sums(data), at, at + window), row["parts"])


def split_large(asked: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows of large buckets (with parts, how many each is split into), suffix by suffix: equal windows go to one part. Part p of bucket k is bucket k + (p + 1) * buckets."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                data, at, places, part = _windows(row, window)
                order, there, starts = _by_bucket(part)
                own = [(data[at[x][:, None] + np.arange(window)].tobytes(), places[x]) for x in np.split(order, starts[1:-1]) if len(x)]
                yield _rows(row["bucket"] + (there + 1) * buckets, row["chunk_id"], own)

    return asked.mapInArrow(split, _ASKED)


def _together(asked: DataFrame, answers: DataFrame, window: int, buckets: int) -> DataFrame:
    """Answers of parts as answers of rows of large buckets."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, at, _, part = _windows(row, window)
                order, _, starts = _by_bucket(part)
                bits = np.zeros(len(at), bool)
                bits[order] = _bits(sorted(row["answers"], key=lambda r: r["part"]), starts)
                yield pa.RecordBatch.from_pydict({"bucket": [row["bucket"]], "chunk_id": [row["chunk_id"]], "answer": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    parts = answers.select((F.col("bucket") % buckets).alias("bucket"), F.col("bucket").alias("part"), "chunk_id", "answer")
    own = parts.groupBy("bucket", "chunk_id").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))  # a chunk's suffixes in a bucket at most
    return asked.join(own, ["bucket", "chunk_id"]).mapInArrow(gather, "bucket long, chunk_id long, answer binary")


def sort_suffixes(chunks: DataFrame, window: int, buckets: int, suffix_buckets: int, bucket_rows: int) -> DataFrame:
    """Per chunk and bucket, a bit for each suffix in the chunk's distinct strings: whether its window also starts earlier."""

    def sort(t: pa.Table) -> pa.Table:
        own = [expand(x.as_py(), np.int64).reshape(-1, 4) for x in t["places"]]
        ids, ties, offsets, sizes = np.concatenate(own).T
        rank = _ranks(ids, ties)
        known, number, k = {}, np.zeros(len(ids), np.int64), 0
        for x, places in zip(t["data"], own, strict=True):
            raw, end = expand(x.as_py(), np.uint8).tobytes(), 0
            for n in (places[:, 3] + window - 1).tolist():
                number[k] = known.setdefault(raw[end : end + n], len(known))
                end, k = end + n, k + 1
        by_place = np.lexsort((offsets, rank))
        lead = by_place[np.unique(number[by_place], return_index=True)[1]]  # of each distinct string, the entry that starts first
        counts = sizes[lead]
        order, same = sorted_suffixes(list(known), window)
        steps = _steps(counts)
        docs, spots = np.repeat(rank[lead], counts), np.repeat(offsets[lead], counts) + steps
        run = np.cumsum(~same) - 1
        by_run = np.lexsort((spots[order], docs[order], run))
        heads = order[by_run[np.flatnonzero(~same)]]  # the suffix of each run that starts first
        least = np.empty(len(order), np.int64)
        least[order] = heads[run]
        steps = _steps(sizes)
        mine = np.repeat((np.cumsum(counts) - counts)[number], sizes) + steps
        docs_here, spots_here = np.repeat(rank, sizes), np.repeat(offsets, sizes) + steps
        least = least[mine]
        earlier = (docs_here > docs[least]) | ((docs_here == docs[least]) & (spots_here > spots[least]))
        parts = np.split(earlier, np.cumsum([int(x[:, 3].sum()) for x in own])[:-1])
        return pa.table({"bucket": t["bucket"], "chunk_id": t["chunk_id"], "answer": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    asked = stage(_asked(chunks, window, buckets, suffix_buckets), "asked")
    large = stage(large_buckets(asked, bucket_rows), "large")
    some = not large.isEmpty()
    if some:
        hot = asked.join(F.broadcast(large), "bucket")  # a row for each LARGE * bucket_rows suffixes at most
        asked = asked.join(F.broadcast(large), "bucket", "left_anti").unionByName(split_large(hot, window, suffix_buckets))
    answers = answered(asked, sort, "bucket long, chunk_id long, answer binary", "suffixes")
    if not some:
        return answers
    part = F.col("bucket") >= suffix_buckets
    return answers.filter(~part).unionByName(stage(_together(hot, answers.filter(part), window, suffix_buckets), "suffixes"))


def large_buckets(asked: DataFrame, bucket_rows: int) -> DataFrame:
    """bucket, parts of buckets of far more than bucket_rows suffixes."""
    sizes = asked.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > LARGE * bucket_rows)
    return sizes.select("bucket", F.ceil(F.col("n") / bucket_rows).cast("long").alias("parts"))


def remove_repeats(docs: DataFrame, window: int = 100, chunk_bytes: int = 2 << 20, bucket_rows: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, removed: array of (start, end) in bytes, kept: the bytes that stay, for each row of docs (doc_id, text)."""
    chunks = bucketed(pack(docs, chunk_bytes), "chunks", "chunk_id", text_bytes(docs))
    size = chunks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-size * len(COVER) // (PERIOD * bucket_rows)))
    known = chunks.join(copies(chunks.drop("data"), window), "chunk_id", "left")
    ranks = rank_samples(known, window, buckets)
    known = with_answers(known, ranks, "ranks")
    # a tied sample makes PERIOD / len(COVER) suffixes where all are tied
    suffix_buckets = max(1, -(-(ranks.agg(F.sum("ties")).first()[0] or 0) * PERIOD // (len(COVER) * bucket_rows)))
    known = with_answers(known, sort_suffixes(known, window, buckets, suffix_buckets, bucket_rows), "verdicts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, window)
                at = c.candidates(*_tied_samples(c, buckets))
                at, sizes, low = c.strings(at)
                first, number, repeats, _ = c.distinct(at, sizes)
                order, _, starts = _by_bucket(_bucket(low[first], suffix_buckets))
                ends = np.append(0, np.cumsum(sizes[first][order]))
                begins = np.empty(len(first), np.int64)
                begins[order] = ends[:-1]
                steps = _steps(sizes)
                earlier = _bits(row["verdicts"], ends[starts])[np.repeat(begins[number], sizes) + steps]
                gone = (np.repeat(at, sizes) + steps)[earlier | np.repeat(repeats, sizes)]
                depth = np.zeros(len(c.data) + 1, np.int32)
                np.add.at(depth, gone, 1)
                np.add.at(depth, gone + window, -1)
                covered = np.cumsum(depth[:-1]) > 0
                removed, kept = [], []
                for s, n, copy in zip(c.starts.tolist(), c.sizes.tolist(), c.copy.tolist(), strict=True):
                    own = np.ones(n, bool) if copy else covered[s : s + n]
                    edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                    removed.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(c.data[s : s + n][~own].tobytes())
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(c.sizes), pa.array(removed, spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return known.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept binary")
