"""Approximate nearest neighbours by a hierarchical k-means tree.

The upper tree is fitted on a bounded sample (`sample` rows by a hash of vec_id) and has at most sample / 4
cells. Every row goes down it to a cell; a cell of more than `leaf_rows` rows is split further by k-means on
all its rows, in its own task, so leaves stay small however many rows there are. Cells that lie next to each
other in the tree share a shard of bounded size; a cell over `shard_rows` rows (copies of one vector, or a
table far larger than the sample) has several, by a hash of vec_id.

A query goes through the tree best bin first: a priority queue by distance to the centres gives it its cells
in order of promise, and in each of them the leaves below. How many cells, and which share of a cell's leaves,
is calibrated: visits are widened until the true neighbours of `calibration` rows that the tree was not
fitted on, found by brute force over all rows, are reached at the recall asked for. A shard's task holds the
shard's rows and lets its queries stream by, so a row moves once for each `query_rows` queries of its shard.
Distances are Euclidean, in double precision on the vectors as given.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those
of another length than the most frequent one (of equally frequent ones the greater), which have no distance
to the others; rows with one vec_id are one candidate at its smallest distance, and as a query the least of
their vectors; a query's own vec_id is no candidate; without valid vectors there are no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from momentlake.llm._shared import stage

_RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Tree:
    """centres: of a node's children; children: their node numbers, or -1 - leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going down to the nearest centre."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = _nearest(x[rows], self.centres[node])
            for k, child in enumerate(self.children[node]):
                own = rows[near == k]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a best-bin-first search opens."""
        if not self.centres:
            return [0]
        queue, out, n = [(0.0, 0, 0)], [], 0
        while queue and len(out) < visits:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            for d, child in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node], strict=True):
                n += 1
                heapq.heappush(queue, (d, n, child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums, there = np.zeros_like(centres), np.flatnonzero(n)
        sums[there] = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(n) - n)[there])
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_tree(x: np.ndarray, leaf: int, branching: int = 8) -> Tree:
    """Splits x by k-means until at most `leaf` rows are left, or rows that k-means can't tell apart."""
    tree, rng = Tree(), np.random.default_rng(3)

    def grow(rows: np.ndarray) -> int:
        k = min(branching, -(-len(rows) // leaf))
        distinct = np.unique(x[rows[: 4 * branching]], axis=0) if k > 1 else ()
        if k < 2 or len(distinct) < 2:
            tree.leaves += 1
            return -tree.leaves
        centres = _kmeans(x[rows], k, rng)
        near = _nearest(x[rows], centres)
        used = np.unique(near)
        if len(used) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.centres)
        tree.centres.append(centres[used])
        tree.children.append([])
        tree.children[node] = [grow(rows[near == k]) for k in used.tolist()]
        return node

    if grow(np.arange(len(x))) < 0:
        tree.centres, tree.children = [], []
    return tree


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats stay floats, other numbers become doubles) of the rows of vectors that take part."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{kind}>").alias("embedding"))
    rows = rows.filter(v.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(v) == (sizes.d if sizes else 0))


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _top(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest ids, each by its nearest row of x, ties to smaller ids."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    d[ids == own] = np.inf
    n = k
    while True:  # more rows until k ids are among them
        near = np.flatnonzero(d <= np.partition(d, n)[n]) if len(d) > n else np.arange(len(d))
        near = near[np.isfinite(d[near])]
        near = near[np.lexsort((ids[near], d[near]))]
        near = near[np.sort(np.unique(ids[near], return_index=True)[1])]
        if len(near) >= k or len(d) <= n:
            return near[:k], d[near[:k]]
        n *= 4


def _exact(index: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """query, shard, cell, leaf of the k nearest rows to each of a bounded set of queries, by brute force over all rows."""
    held = index.sparkSession.sparkContext.broadcast((queries, ids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = held.value
        for batch in batches:
            for b in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x, ids = _matrix(b["embedding"], b.num_rows), b["vec_id"].to_numpy()
                found = [_top(q, o, x, ids, k) for q, o in zip(queries, own.tolist(), strict=True)]
                place, d = (np.concatenate(c) for c in zip(*found, strict=True))
                query = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(query), *(b[c].take(pa.array(place)) for c in ("vec_id", "shard", "cell", "leaf")), pa.array(d)], ["query", "vec_id", "shard", "cell", "leaf", "score"])

    rows = index.select("vec_id", "shard", "cell", "leaf", "embedding").mapInArrow(nearest, "query long, vec_id long, shard int, cell int, leaf int, score double")
    rows = rows.groupBy("query", "vec_id").agg(F.min(F.struct("score", "shard", "cell", "leaf")).alias("nearest")).select("query", "vec_id", "nearest.*")
    first = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    return rows.withColumn("rank", first).filter(F.col("rank") <= k).select("query", "shard", "cell", "leaf")


def build_index(rows: DataFrame, tree: Tree, leaf_rows: int, shard_rows: int) -> tuple[DataFrame, dict[int, range]]:
    """shard, cell, leaf, vec_id, embedding of rows, and on one row of each cell's part that was split further the tree below it; and the shards of each cell."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(tree)  # of a size fixed by the sample
    vector = rows.schema["embedding"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = held.value.assign(_matrix(b["embedding"], b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    located = stage(rows.mapInArrow(assigned, f"vec_id long, embedding {vector}, cell int"), "cells")
    shards = _shards(located, shard_rows)
    places = F.broadcast(spark.createDataFrame(shards, "cell int, shard int, shards int"))  # a row for each cell
    own = (F.col("shard") + F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).alias("shard")

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        x, cell = _matrix(t["embedding"].combine_chunks(), t.num_rows), t["cell"].to_numpy()
        leaf, trees = np.zeros(len(x), np.int32), [None] * len(x)
        edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 2 * leaf_rows:
                below = fit_tree(x[a:b], leaf_rows)
                if below.centres:
                    leaf[a:b], trees[a] = below.assign(x[a:b]), pickle.dumps(below)
        return t.append_column("leaf", pa.array(leaf)).append_column("tree", pa.array(trees, pa.binary())).select(["shard", "cell", "leaf", "vec_id", "embedding", "tree"])

    dealt = located.join(places, "cell").select(own, "cell", "vec_id", "embedding")
    index = stage(dealt.groupBy("shard").applyInArrow(grow, f"shard int, cell int, leaf int, vec_id long, embedding {vector}, tree binary"), "index")
    return index, {cell: range(first, first + n) for cell, first, n in shards}


def _shards(located: DataFrame, shard_rows: int) -> list[tuple[int, int, int]]:
    """cell, its first shard and how many it has: neighbouring cells share a shard, a cell over shard_rows has several of its own."""
    out, shard, filled = [], 0, 0
    for cell, n in sorted((r.cell, r.n) for r in located.groupBy("cell").agg(F.count("*").alias("n")).collect()):  # a row for each cell
        if filled and filled + n > shard_rows:
            shard, filled = shard + 1, 0
        if n > shard_rows:
            out.append((cell, shard, -(-n // shard_rows)))
            shard += out[-1][2]
        else:
            out.append((cell, shard, 1))
            filled += n
    return out


@dataclass
class Visits:
    """How many cells a query opens, and which share of the leaves of each; recall: reached on the calibration rows."""

    cells: int
    share: float
    recall: float


def calibrate(tree: Tree, index: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, recall: float) -> Visits:
    """The fewest leaf visits at which the calibration queries' true neighbours are reached at this recall."""
    cells = max(1, tree.leaves)
    if not len(queries):
        return Visits(cells, 1.0, 1.0)
    found = stage(_exact(index, queries, ids, k), "calibration")  # k rows a calibration query
    held = index.sparkSession.sparkContext.broadcast(queries)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depths = []
            for query, leaf, blob in zip(b["query"].to_pylist(), b["leaf"].to_pylist(), b["tree"], strict=True):
                below = pickle.loads(blob.as_py())  # noqa: S301
                depths.append(below.best_bins(held.value[query], below.leaves).index(leaf) / below.leaves)
            yield pa.RecordBatch.from_arrays([b["query"], b["cell"], pa.array(depths, pa.float64())], ["query", "cell", "depth"])

    trees = index.filter("tree is not null").select("shard", "cell", "tree")
    deep = found.join(trees, ["shard", "cell"]).select("query", "cell", "leaf", "tree").mapInArrow(placed, "query long, cell int, depth double")
    flat = found.join(trees, ["shard", "cell"], "left_anti").select("query", "cell", F.lit(-1.0).alias("depth"))
    order = [{cell: i for i, cell in enumerate(tree.best_bins(q, cells))} for q in queries]
    hits = np.array([(order[r.query][r.cell], r.depth) for r in deep.unionByName(flat).collect()]).reshape(-1, 2)
    if not len(hits):
        return Visits(cells, 1.0, 1.0)
    best, split = Visits(cells, 1.0, 1.0), (hits[:, 1] >= 0).mean()
    for share in np.arange(0.05, 1.01, 0.05) if split else (1.0,):
        cost = 1 - split * (1 - share)  # of a cell, by how often cells are split further
        reached = np.sort(hits[hits[:, 1] < share, 0])
        need = int(np.ceil(recall * len(hits)))
        if need <= len(reached) and (visits := int(reached[need - 1]) + 1) * cost < best.cells * (1 - split * (1 - best.share)):
            best = Visits(visits, float(share), float((reached < visits).sum() / len(hits)))
    return best


def fit(rows: DataFrame, k: int, recall: float, sample: int, leaf_rows: int, calibration: int, shard_rows: int) -> tuple[Tree, DataFrame, dict[int, range], Visits]:
    """The upper tree, the index, the shards of its cells and the calibrated visits of the rows of valid()."""
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample + calibration).toArrow()  # a bounded sample
    x, ids = _matrix(drawn["embedding"].combine_chunks(), drawn.num_rows), drawn["vec_id"].to_numpy()
    own = min(calibration, len(x) // 4)  # the tree is fitted on others
    tree = fit_tree(x[own:], max(4, leaf_rows * (len(x) - own) // total))
    index, places = build_index(rows, tree, leaf_rows, shard_rows)
    return tree, index, places, calibrate(tree, index, x[:own], ids[:own], k, recall)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.94, sample: int = 1 << 16, leaf_rows: int = 16, calibration: int = 256, shard_rows: int = 8192, query_rows: int = 1 << 16
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) with is_query its k nearest other rows found."""
    spark = vectors.sparkSession
    rows = stage(valid(vectors), "vectors")
    if rows.isEmpty():
        return spark.createDataFrame([], _RESULT)
    tree, index, places, visits = fit(rows, k, recall, sample, leaf_rows, calibration, shard_rows)
    held, vector = spark.sparkContext.broadcast((tree, places)), rows.schema["embedding"].dataType.simpleString()

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, places = held.value
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                at, shards, cells = [], [], []
                for i, q in enumerate(_matrix(b["embedding"], b.num_rows)):
                    own: dict[int, list[int]] = {}
                    for cell in tree.best_bins(q, visits.cells):
                        for shard in places.get(cell, ()):
                            own.setdefault(shard, []).append(cell)
                    at += [i] * len(own)
                    shards += own
                    cells += own.values()
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(shards, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "embedding", "shard", "cells"])

    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stage(queries.mapInArrow(routed, f"vec_id long, embedding {vector}, shard int, cells array<int>"), "asked")
    groups = asked.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("groups"))
    asked = asked.join(groups, "shard").withColumn("g", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    parts = index.join(groups, "shard").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    columns = ["shard", "g", "kind", "cell", "leaf", "vec_id", "embedding", "tree", "cells"]
    parts = parts.withColumns({"kind": F.lit(0), "cells": F.lit(None).cast("array<int>")}).select(columns)
    asked = asked.withColumns({"kind": F.lit(1), "cell": F.lit(-1), "leaf": F.lit(-1), "tree": F.lit(None).cast("binary")}).select(columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key = None, None
        for b in batches:
            own = np.stack([b[c].to_numpy() for c in ("shard", "g", "kind")], 1)
            edges = np.flatnonzero((np.diff(own, axis=0, prepend=own[:1] - 1) != 0).any(1)).tolist()
            for start, stop in zip(edges, [*edges[1:], b.num_rows], strict=True):
                part, (s, g, kind) = b.slice(start, stop - start), own[start].tolist()
                if kind == 0:
                    if key != (s, g):
                        shard, key = Shard(), (s, g)
                    shard.add(part)
                elif key == (s, g):
                    yield shard.answers(part, k, visits.share)

    both = parts.unionByName(asked).repartition("shard", "g").sortWithinPartitions("shard", "g", "kind", "cell", "leaf", "vec_id")
    found = both.mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """A shard's rows, by cell and leaf, and the trees below its cells."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.x: np.ndarray | None = None

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part.select(["cell", "leaf", "vec_id", "embedding", "tree"]))

    def _open(self) -> None:
        t = pa.Table.from_batches(self.parts)
        self.parts = []
        self.x, self.ids = _matrix(t["embedding"].combine_chunks(), t.num_rows), t["vec_id"].to_numpy()
        cell, leaf = t["cell"].to_numpy(), t["leaf"].to_numpy()
        trees = t["tree"].combine_chunks()
        self.trees = {int(cell[i]): pickle.loads(trees[i].as_py()) for i in np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False)).tolist()}  # noqa: S301
        starts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(leaf, prepend=-1) != 0)).tolist()
        self.rows: dict[int, dict[int, slice]] = {}
        for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True):
            self.rows.setdefault(int(cell[a]), {})[int(leaf[a])] = slice(a, b)

    def answers(self, asked: pa.RecordBatch, k: int, share: float) -> pa.RecordBatch:
        if self.x is None:
            self._open()
        out: list[list] = [[], [], []]
        for query, q, cells in zip(asked["vec_id"].to_pylist(), _matrix(asked["embedding"], asked.num_rows), asked["cells"].to_pylist(), strict=True):
            slices = []
            for cell in cells:
                leaves = self.rows.get(cell, {})
                if below := self.trees.get(cell):
                    slices += [leaves[i] for i in below.best_bins(q, math.ceil(share * below.leaves - 1e-9)) if i in leaves]
                else:
                    slices += leaves.values()
            if not slices:
                continue
            at = np.concatenate([np.arange(s.start, s.stop) for s in slices])
            near, d = _top(q, query, self.x[at], self.ids[at], k)
            for column, values in zip(out, ([query] * len(near), self.ids[at][near].tolist(), d.tolist()), strict=True):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])
