"""MinHash near-dedup with odd sketches.

Each document is its set of distinct word shingles. MinHash samples give band keys and are folded into parity
bitmaps (odd sketches): the number of ones in the XOR of two bitmaps estimates the similarity of two sets,
most exactly where it is high. Documents with equal sets are one node.

1. Nodes that share a band key are a bucket. In a bucket, pairs whose bitmaps reach the threshold, give or take
   what chance may do to an estimate, are linked, nearest first and only while they are not linked already;
   what only shares a key by accident goes apart here. Nodes that are linked through such pairs are a family.
2. In a family, pairs are confirmed on the full sets, by falling estimate and only while they lie in different
   components of confirmed links. Components close over confirmed links alone.

Buckets and families of over `block` nodes are split alike: each block is linked on its own, with the group's
first node in all of them; nodes that are not in the group's largest component by then are tried against all of
its nodes, block by block. So no link is lost that would join two documents, and a task holds two blocks at most. A
group whose nodes link turns into few pairs; one of many nodes that look alike and do not link is compared pair by
pair by its bitmaps.

Bitmaps leave a pair out only if it is four and a half standard deviations (of samples and bits together) below
the threshold; where many are left to try, a second, far larger bitmap does so once more.

Defined cases: a text with fewer words than a shingle is one shingle; a null text, or one without words, is
an empty set and linked with nothing; rows with one doc_id are one document, all their sets are linked and
they share component_id and kept; rows with a null doc_id are linked with nothing, their component is null and
they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import stage, text_slices
from momentlake.llm._words import U, mix, words
from momentlake.llm.components import components

BANDS, ROWS = 40, 6
SMALL, LARGE = (BANDS * ROWS, 512), (2048, 16384)  # samples and bits of the sketches
_RNG = np.random.default_rng(31)
_ADD = _RNG.integers(0, 1 << 32, LARGE[0], dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, LARGE[0], dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = U(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, one after the other, and n + 1 offsets."""
    h, offsets = words(column)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    last = len(h) - size + 1
    s = np.zeros(max(last, 0), U)
    for i in range(size if last > 0 else 0):
        s = (s + h[i : i + last]) * _STEP
    whole = row[: max(last, 0)] == row[size - 1 :] if last > 0 else np.zeros(0, bool)
    out, rows = [mix(s[whole])], [row[: len(whole)][whole]]
    for r in np.flatnonzero((n > 0) & (n < size)).tolist():
        v = U(0)
        with np.errstate(over="ignore"):
            for x in h[offsets[r] : offsets[r + 1]]:
                v = (v + x) * _STEP
        out.append(mix(np.array([v + U(n[r])])))
        rows.append(np.array([r]))
    s, row = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    s, row = s[order], row[order]
    cuts = np.searchsorted(row, np.arange(len(n) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def minhash(sets: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """That many samples of each of the non-empty sets that begin at starts."""
    low = (sets >> U(32)).astype(np.uint32)
    out = np.empty((len(starts), count), np.uint32)
    ends = np.append(starts[1:], len(sets))
    first = 0
    while first < len(starts):  # blocks that stay in the cache
        stop = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 15), "right")))
        part, at = low[starts[first] : ends[stop - 1]], starts[first:stop] - starts[first]
        for k in range(count):
            out[first:stop, k] = np.minimum.reduceat((part ^ _ADD[k]) * _TIMES[k], at)
        first = stop
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), U)
    for r in range(ROWS):
        keys = (keys + samples[:, r::ROWS].astype(U) + U(1)) * _STEP
    return mix(keys + np.arange(BANDS, dtype=U)).view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: each sample, salted by its place, toggles one bit."""
    n, k = samples.shape
    bit = (mix(samples.astype(U) + (np.arange(k, dtype=U) << U(32))) % U(bits)).astype(np.int64)
    ones = np.bincount((np.arange(n)[:, None] * bits + bit).ravel(), minlength=n * bits) & 1
    return np.packbits(ones.astype(np.uint8).reshape(n, bits), axis=1)


def most_ones(similarity: float, sketch: tuple[int, int], margin: bool = True) -> int:
    """Ones in the XOR of two sketches of sets of that similarity: as expected, or, with margin, as good as never more."""
    samples, bits = sketch
    load = 4 * samples * (1 - similarity) / bits
    ones = bits / 2 * (1 - np.exp(-load))
    by_samples = 2 * samples * np.exp(-load) * np.sqrt(similarity * (1 - similarity) / samples)
    return int(ones + margin * 4.5 * np.sqrt(by_samples**2 + ones))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set; null if empty), sketch, keys of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            sets, offsets = shingle_sets(b["text"], size)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            ids, sketches, keys = [None] * len(n), [None] * len(n), [None] * len(n)
            if len(full):
                starts = offsets[:-1][full]
                digest = np.stack([np.add.reduceat(mix(sets ^ U(salt)), starts) for salt in (0x5BF03635, 0x2545F491)], 1)
                samples = minhash(sets, starts, SMALL[0])
                for i, d, s, k in zip(full.tolist(), digest, odd_sketches(samples, SMALL[1]), band_keys(samples), strict=True):
                    ids[i], sketches[i], keys[i] = d.tobytes(), s.tobytes(), k
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(signed, "doc_id long, n_shingles long, set_id binary, sketch binary, keys array<long>")


class _Group:
    """Nodes of one task: component labels, which grow together, sketches and, to confirm pairs, full sets."""

    def __init__(self, t: pa.Table, percent: int, confirm: bool) -> None:
        self.node, self.percent, self.confirm = t["node"].to_numpy(), percent, confirm
        self.label = np.unique(t["component"].to_numpy(), return_inverse=True)[1]
        self.sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), U).reshape(len(self.node), -1)
        if confirm:
            flat = t["shingles"].combine_chunks()
            offsets = flat.offsets.to_numpy()
            self.flat, self.starts = flat.flatten().to_numpy().view(U), offsets - offsets[0]
        self.large: np.ndarray | None = None
        self.most = [most_ones(percent / 100, k) for k in (SMALL, LARGE)]
        self.links: list[tuple[int, int]] = []

    def try_pair(self, a: int, b: int) -> None:
        if self.label[a] == self.label[b]:
            return
        if self.confirm:
            x, y = (self.flat[self.starts[k] : self.starts[k + 1]] for k in (a, b))
            if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
                return
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both < self.percent * (len(x) + len(y) - both):
                return
        self.links.append((self.node[a], self.node[b]))
        self.label[self.label == self.label[b]] = self.label[a]

    def forest(self) -> None:
        """Tries a minimum spanning tree of the sketches' distances, shortest edges first."""
        m = len(self.node)
        best, link, left, edges, at = np.full(m, 1 << 30), np.zeros(m, np.int64), np.ones(m, bool), [], 0
        for _ in range(m - 1):
            left[at] = False
            ones = np.bitwise_count(self.sketch ^ self.sketch[at]).sum(1, dtype=np.int64)
            closer = ones < best
            best[closer], link[closer] = ones[closer], at
            at = int(np.where(left, best, 1 << 31).argmin())
            edges.append((int(best[at]), int(link[at]), at))
        for ones, a, b in sorted(edges):
            if ones <= self.most[0]:
                self.try_pair(a, b)

    def across(self, k: int, others: np.ndarray) -> None:
        """Tries k with all others that may reach the threshold, most similar first."""
        near = others[self.label[others] != self.label[k]]
        ones = np.bitwise_count(self.sketch[near] ^ self.sketch[k]).sum(1, dtype=np.int64)
        near, ones = near[ones <= self.most[0]], ones[ones <= self.most[0]]
        if self.confirm and len(near) > 32:
            if self.large is None:
                parts = [slice(i, min(i + 64, len(self.node))) for i in range(0, len(self.node), 64)]
                sketches = [odd_sketches(minhash(self.flat[self.starts[p.start] : self.starts[p.stop]], self.starts[p] - self.starts[p.start], LARGE[0]), LARGE[1]) for p in parts]
                self.large = np.concatenate(sketches).view(U)
            ones = np.bitwise_count(self.large[near] ^ self.large[k]).sum(1, dtype=np.int64)
            near, ones = near[ones <= self.most[1]], ones[ones <= self.most[1]]
        for j in near[np.argsort(ones, kind="stable")].tolist():
            self.try_pair(k, j)


def _linked(rows: DataFrame, percent: int, confirm: bool) -> DataFrame:
    """Edges (a, b) from nodes to the least node they are linked with, within groups by (g, i, p) of rows (g, i, p, node, component, probe, sketch and, to confirm, shingles).

    Components in which no link was found give no edges. Groups are runs of sorted rows, as most hold two or three.
    """

    def link(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        f, probe = _Group(t, percent, confirm), t["probe"].to_numpy(zero_copy_only=False)
        every = np.arange(len(f.node))
        if not probe.any():
            f.forest()  # without confirmation this is all: the pairs that pass and are left out close circles
            for k in every[:-1].tolist() if confirm else []:
                f.across(k, every[k + 1 :])
        for k in np.flatnonzero(probe).tolist():
            f.across(k, every)
        ends = np.unique(np.array(f.links, np.int64).ravel())
        least = np.full(int(f.label.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, f.label, f.node)
        at = np.isin(f.node, ends)
        return f.node[at], least[f.label[at]]

    def pairs(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of two rows, all at once."""
        one, two = (t.take(pa.array(starts + k)).select(["node", "sketch"]) for k in (0, 1))
        a, b = (np.frombuffer(b"".join(x["sketch"].to_pylist()), U).reshape(len(starts), -1) for x in (one, two))
        near = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= most_ones(percent / 100, SMALL)
        nodes = np.stack([one["node"].to_numpy()[near], two["node"].to_numpy()[near]])
        return nodes.max(0, initial=-(1 << 63)), nodes.min(0, initial=(1 << 63) - 1)

    def linked(t: pa.Table, keys: np.ndarray, last: bool) -> tuple[pa.RecordBatch, int]:
        """The links of the runs in t, and where its last run starts, which is left unless it is the last of all."""
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        ends = np.append(starts[1:], len(keys))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        parts = []
        two = (ends - starts == 2) & (not confirm)
        if two.any():
            parts.append(pairs(t, starts[two]))
        for x, y in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
            if y - x > 1:
                parts.append(link(t.slice(x, y - x)))
        a, b = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), int(ends[-1]) if len(ends) else 0

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, grown = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 2 * grown:  # a long run: wait until there is twice as much
                continue
            t = pa.Table.from_batches(held)
            out, done = linked(t, np.stack([t[c].to_numpy() for c in ("g", "i", "p")], 1), last=False)
            yield out
            t = t.slice(done)
            held, n, grown = t.to_batches(), t.num_rows, t.num_rows
        if n:
            t = pa.Table.from_batches(held)
            yield linked(t, np.stack([t[c].to_numpy() for c in ("g", "i", "p")], 1), last=True)[0]

    key = ["g", "i", "p"]
    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, "node")
    return sorted_rows.mapInArrow(runs, "a long, b long").filter("a <> b").distinct()


def _group_links(groups: DataFrame, percent: int, block: int, confirm: bool) -> DataFrame:
    """Edges that close to the components of all links within groups (g, n: nodes in it, first: its least node, node, sketch and, to confirm, shingles)."""
    data = ["node", "sketch", *(["shingles"] if confirm else [])]
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = groups.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.when(F.col("node") == F.col("first"), every).otherwise(F.array("i"))  # the first node is in all blocks
    one = rows.select("g", F.explode(own).alias("i"), F.lit(0).alias("p"), F.col("node").alias("component"), F.lit(False).alias("probe"), *data)
    links = stage(_linked(one, percent, confirm), "links")
    wide = rows.filter("blocks > 1")
    if wide.isEmpty():
        return links
    split = wide.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = split.groupBy("g", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("g").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("probes")).filter("probes > 0")
    main = main.withColumn("p_blocks", F.ceil(F.col("probes") / block).cast("int"))
    split = stage(split.join(main, "g"), "split")
    p = F.pmod(F.xxhash64("node", F.lit(1)), F.col("p_blocks")).cast("int").alias("p")
    probes = split.filter("component <> main").select("g", F.explode(every).alias("i"), p, "component", F.lit(True).alias("probe"), *data)
    base = split.select("g", "i", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)).alias("p"), "component", F.lit(False).alias("probe"), *data)
    return links.unionByName(stage(_linked(probes.unionByName(base), percent, confirm), "links"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = 512, bucket: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept: a row for each row of docs (doc_id, text)."""
    signed = stage(signatures(docs, size), "signatures")
    least = F.min(F.struct("doc_id", "sketch", "keys")).alias("m")  # a node's own row
    members = signed.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(least)
    members = stage(members.select("set_id", F.col("m.doc_id").alias("node"), "m.sketch", "m.keys"), "nodes")
    # rows of one doc_id with several sets
    sets = signed.filter("doc_id is not null").select("doc_id", "set_id")
    several = sets.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("two"), F.count("set_id").alias("full"), F.count("*").alias("rows"))
    several = several.filter("one <> two or (full > 0 and full < rows)").select("doc_id")
    repeated = stage(sets.join(several, "doc_id", "left_semi").join(members.select("set_id", "node"), "set_id", "left").select("doc_id", "node").distinct(), "repeated")

    keyed = members.select("node", F.explode("keys").alias("g"))
    shared = keyed.groupBy("g").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    buckets = stage(keyed.join(shared, "g").join(members.select("node", "sketch"), "node"), "buckets")
    families = stage(components(_group_links(buckets, percent, bucket, confirm=False)).select("node", F.col("component").alias("g")), "families")
    placed = families.join(families.groupBy("g").agg(F.count("*").alias("n")), "g").withColumn("first", F.col("g"))  # a component's name is its least node
    groups = stage(placed.join(_sets(docs, families.select("node"), size), "node"), "sets")
    links = _group_links(groups, percent, block, confirm=True)

    hubs = repeated.groupBy("doc_id").agg(F.min("node").alias("b"))
    same = repeated.join(hubs, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")
    joined = components(links.unionByName(same))
    named = members.select("set_id", "node").join(joined, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    # an empty set goes with the other sets of its doc_id
    mates = repeated.filter("node is not null").join(joined, "node", "left").groupBy("doc_id").agg(F.least(F.min(F.coalesce("component", "node")), F.col("doc_id")).alias("mate"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("mate", "component_id", "doc_id"))
    out = out.join(mates, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, sketch and full set of shingles, from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            s, offsets = shingle_sets(b["text"], size)
            full = np.flatnonzero(np.diff(offsets))
            starts = offsets[:-1][full]
            sketches = odd_sketches(minhash(s, starts, SMALL[0]), SMALL[1]) if len(full) else []
            ends = np.append(starts, len(s)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(full)), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(s.view(np.int64)))], ["node", "sketch", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return texts.mapInArrow(sets, "node long, sketch binary, shingles array<long>")
