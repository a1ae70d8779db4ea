"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most `capacity` tokens. Pieces that fill a sequence are done; the others are
dealt at random to groups of about `group_rows` pieces and packed there by best-fit decreasing. Dual-feasible
functions give a lower bound on each group's bin count. A group whose count equals the bound is certified and
keeps its sequences (but gives up a last one less than half full); a group with a gap gives up its emptiest
sequences, in proportion to the gap but at most half of them. What was given up is dealt anew to fewer groups and
packed again, until one group holds the rest. A group has the tokens of eight sequences or more on average, so a
round gives up at most nine sixteenths of its tokens and the rounds end, whatever the lengths are. No piece and no
text passes the driver; it sees counts alone.

Ids are those of the vocabulary's tokenizers file: the text of its special token, wherever it occurs, is that one id.

Defined cases: a null or empty text is the end id alone; white space of any length is tokenized like any other text; rows that repeat a doc_id are packed as they come,
each with all its pieces; an empty table gives no rows; columns of pieces called sequence_id or offset are replaced,
all others stay whatever their names are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import stage, unused
from momentlake.llm.chat import default_ranks, encode_text

SPECIAL = (("<|endoftext|>", 50256),)  # fixed value: the special token of the vocabulary and its id
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, capacity: int = 2048, end_id: int = 0, ranks: str | None = None, with_ids: bool = False, special: tuple[tuple[str, int], ...] = SPECIAL) -> DataFrame:
    """Pieces of doc_id and text of docs; with_ids adds their token ids."""
    ranks = ranks or default_ranks()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out: list[list] = [[] for _ in range(5 + with_ids)]
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    ids = np.array([*encode_text(ranks, text.as_py() or "", special), end_id], "<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32)), strict=False):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(pieces, _PIECES + (", ids array<int>" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has r tokens of room
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int(sizes @ counts) // capacity)
    for k in range(1, 25):  # x stays where (k + 1) x is a multiple of the capacity, else it is rounded down to a k-th
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, sizes * k, scaled // capacity * capacity) @ counts
        best = max(best, -(-int(value) // (capacity * k)))
    total, n = np.concatenate([[0], np.cumsum(sizes * counts)]), np.concatenate([[0], np.cumsum(counts)])
    for small in np.unique(np.concatenate([[0], sizes[sizes <= capacity // 2]])).tolist():  # above capacity - small counts whole, below small nothing
        large, low = np.searchsorted(sizes, capacity - small, "right"), np.searchsorted(sizes, small, "left")
        best = max(best, int(n[-1] - n[large]) + -(-int(total[large] - total[low]) // capacity))
    return best


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces, which need a column length of 1 to capacity."""
    pieces = stage(pieces.drop("sequence_id", "offset"), "pieces")
    columns = pieces.columns
    out = unused(columns, "out")[0]
    full = pieces.filter(F.col("length") >= capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, turn = pieces.filter(F.col("length") < capacity), [full], 0
    while True:
        rows, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(math.ceil(rows / group_rows), tokens // (8 * capacity)))
        result = stage(_packed(rest, groups, turn, capacity, out), "packed")
        done.append(result.filter(~F.col(out)).drop(out))
        if groups == 1:
            break
        rest, turn = result.filter(out).select(*columns), turn + 1
    return reduce(DataFrame.unionByName, done)


def _packed(rest: DataFrame, groups: int, turn: int, capacity: int, given_up: str) -> DataFrame:
    """One round: rows of rest with sequence_id, offset and a column given_up, true for those that are given up."""
    name = unused([*rest.columns, given_up], "group")[0]

    def packed(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, n)
        gap = n - lower_bound(lengths, capacity)
        emptiest = np.argsort(fill, kind="stable")
        out = np.zeros(n, bool)
        if groups > 1:
            out[emptiest[: min(n // 2, 8 * gap)] if gap else emptiest[:1][fill[emptiest[:1]] < capacity // 2]] = True
        group = table[name][0].as_py()
        return (
            table.drop_columns([name])
            .append_column("sequence_id", pa.array((turn << 54) + (group << 24) + bins))
            .append_column("offset", pa.array(offsets))
            .append_column(given_up, pa.array(out[bins]))
        )

    dealt = rest.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return dealt.groupBy(name).applyInArrow(packed, f"{fields}, sequence_id long, offset long, `{given_up}` boolean")
