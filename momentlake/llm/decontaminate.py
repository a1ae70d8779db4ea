"""Benchmark decontamination by template windows.

Texts become template tokens: words lower-cased and stripped of punctuation; a number is the placeholder
<number>, a unit right after a number <unit>, and a capitalised word (one upper-case letter, then a lower-case one) that does not
open a sentence <name>;
each placeholder keeps its value as a slot. Windows of `window` tokens of the benchmark items (the whole
item, where it is shorter) are matched with the documents' windows by hash, and a match counts only if its
slots are consistent: equal slot values of the item stand for equal values in the document and the other way
round. So copies match, and so do questions with other numbers or names.

Each window is read in three ways, each with its own hash: as it stands; with all capitalised words as names,
where those that open a sentence on either side must be equal; and word for word. So a copy matches whatever
stands before it, however its lines are broken and however few plain words it has.

Items of under `least` tokens, and items none of whose windows has plain words for half of its tokens, match
as a whole too: as templates (with two plain words at least) or word for word, where they stand as sentences of
their own. So "What is 12 + 35 - 7?" is found again with other numbers, and a phrase of two words does not mark
every text that uses it.

The benchmark's windows go to the tasks as sorted arrays of at most `bound` windows; a larger benchmark is
taken in several passes, each within the bound and written as a table before the next one. Documents are never
shuffled. Of items that share a window (its template and which of its slots are equal), the least item_id stands
for all.

Defined cases: null or empty texts match nothing, nor do items of one token; windows less than half of which
are plain words match word for word only, but for whole items as above; repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import stage, text_slices
from momentlake.llm._words import U, buffers, mix, powers, prefix_sums, span_hash, word_spans

UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz lb lbs pound pounds ton tons "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts joule joules meter meters metre metres kilometer kilometers"
).split()
WORD, NUMBER, UNIT, NAME = range(4)
TEMPLATE, NAMES, EXACT = range(3)  # readings of a window
WHOLE = 3  # added to a reading: the window is an item that stands as sentences of its own
_CORE = np.zeros(256, bool)
_CORE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CLOSE = np.isin(np.arange(256), np.frombuffer(b"\"')]*_", np.uint8))
_PLACE = mix(np.arange(1, 5, dtype=U))


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0 to U+00DE."""
    out = data + np.where((data >= 0x41) & (data <= 0x5A), 32, 0).astype(np.uint8)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] += 32
    return out


def _unit_hashes() -> np.ndarray:
    data, offsets = buffers(pa.array(UNITS))
    return np.sort(span_hash(prefix_sums(data), offsets[:-1], offsets[1:]))


def _before_closers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last byte of each word that is no closing quote, bracket or emphasis (of up to four)."""
    last = ends - 1
    for _ in range(4):
        curly = (last >= starts + 3) & np.isin(data[last], (0x99, 0x9D)) & (data[last - 1] == 0x80) & (data[last - 2] == 0xE2)
        last = last - np.where(curly, 3, (_CLOSE[data[last]] & (last > starts)).astype(np.int64))
    return last


class Templates:
    """Template tokens of a text column: code (hash of the word or of the placeholder), kind, value (hash), row."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = buffers(column)
        starts, ends, row = word_spans(data, offsets)
        core = np.concatenate([[0], np.cumsum(_CORE[data])])
        place = np.flatnonzero(_CORE[data])
        held = core[ends] > core[starts]
        stop = np.zeros(len(starts), bool)  # the word ends a sentence
        if len(starts):
            stop = np.isin(data[_before_closers(data, starts, ends)], np.frombuffer(b".!?:", np.uint8))
            breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
            stop[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
        opens = np.ones(len(starts), bool)
        opens[1:] = stop[:-1] | (row[1:] != row[:-1])
        seen = np.concatenate([[0], np.cumsum(opens)])
        kept = np.flatnonzero(held)
        opens = np.diff(seen[kept + 1], prepend=0) > 0  # words without letters pass it on
        starts, ends, row = starts[held], ends[held], row[held]
        a, b = place[core[starts]], place[core[ends] - 1] + 1
        value = span_hash(prefix_sums(_lower(data)), a, b)
        more = np.concatenate([data, np.zeros(4, np.uint8)])
        first, accented = more[a], more[a] == 0xC3
        after = a + 1 + accented  # the letter that follows the first one
        upper = ((first >= 0x41) & (first <= 0x5A)) | (accented & (more[a + 1] >= 0x80) & (more[a + 1] <= 0x9E))
        lower = ((more[after] >= 0x61) & (more[after] <= 0x7A)) | ((more[after] == 0xC3) & (more[after + 1] >= 0x9F))
        kind = np.zeros(len(a), np.int8)
        capital = upper & lower & (after < b)
        kind[capital & ~opens] = NAME
        kind[(first >= 0x30) & (first <= 0x39)] = NUMBER
        if len(a):
            units = _unit_hashes()
            known = units[np.searchsorted(units, value).clip(max=len(units) - 1)] == value
            known[1:] &= (kind[:-1] == NUMBER) & (row[1:] == row[:-1])
            known[0] = False
            kind[known] = UNIT
        self.row, self.value = row, value
        self.first, self.last = opens, np.append(opens[1:], True)[: len(opens)]
        names = np.where(capital & (kind == WORD), NAME, kind).astype(np.int8)
        self.opens = names != kind
        self.kinds = (kind, names, np.full(len(kind), WORD, np.int8))
        self.bounds = np.searchsorted(row, np.arange(len(column) + 1))
        up = powers(len(a) + 1)[0][: len(a)]
        self._sums = [np.concatenate([np.zeros(1, U), np.cumsum(np.where(k == WORD, value, _PLACE[k]) * up)]) for k in self.kinds]
        self._words = [np.concatenate([[0], np.cumsum(k == WORD)]) for k in self.kinds]
        self._capitals = np.concatenate([[0], np.cumsum(names == NAME)])

    def windows(self, n: int, reading: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window of n tokens that lies in one row and that the reading allows."""
        at = np.arange(max(0, len(self.row) - n + 1))
        sums, words = self._sums[reading % WHOLE], self._words[reading % WHOLE]
        plain = words[at + n] - words[at]
        right = self.row[at] == self.row[at + n - 1]
        if reading >= WHOLE:
            right &= self.first[at] & self.last[at + n - 1] & (plain >= 2)
        else:
            right &= 2 * plain >= n
        if reading % WHOLE == NAMES:  # without capitalised words it is the template
            right &= self._capitals[at + n] > self._capitals[at]
        at = at[right]
        return at, mix((sums[at + n] - sums[at]) * powers(len(sums))[1][at] + U(n))

    def slots(self, at: int, n: int, reading: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
        """Values of the slots, and which of them are capitalised words that open a sentence."""
        slot = np.flatnonzero(self.kinds[reading % WHOLE][at : at + n] != WORD) + at
        return self.value[slot], self.opens[slot] if reading % WHOLE == NAMES else np.zeros(len(slot), bool)

    def item_windows(self, window: int, least: int) -> Iterator[tuple[int, int, int, int]]:
        """Size, reading, first token and hash of the windows by which each row, as an item, is found."""
        sizes = np.diff(self.bounds)
        plain = np.zeros(len(sizes), bool)  # has a template window
        for n in np.unique(np.minimum(sizes, window)).tolist():
            for reading in (TEMPLATE, NAMES, EXACT) if n >= least else ():
                at, hashes = self.windows(n, reading)
                own = np.minimum(sizes[self.row[at]], window) == n
                plain[self.row[at[own]]] |= reading != EXACT
                yield from ((n, reading, k, h) for k, h in zip(at[own].tolist(), hashes[own].view(np.int64).tolist(), strict=True))
        whole = ~plain & (sizes >= 2)
        for n in np.unique(sizes[whole]).tolist():
            for reading in (TEMPLATE, NAMES, EXACT) if n < least else (TEMPLATE, NAMES):
                at, hashes = self.windows(n, reading + WHOLE)
                own = whole[self.row[at]] & (sizes[self.row[at]] == n)
                yield from ((n, reading + WHOLE, k, h) for k, h in zip(at[own].tolist(), hashes[own].view(np.int64).tolist(), strict=True))


def consistent(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether equal values on either side stand opposite equal values."""
    pairs = set(zip(one.tolist(), two.tolist(), strict=True))
    return len(pairs) == len(set(one.tolist())) == len(set(two.tolist()))


def _pattern(values: np.ndarray) -> np.ndarray:
    """Equal numbers for equal values, in order of appearance: all that counts for consistency."""
    first, inverse = np.unique(values, return_index=True, return_inverse=True)[1:]
    return first[inverse]


def benchmark_windows(benchmark: DataFrame, window: int, least: int) -> DataFrame:
    """reading, hash, n, slots, opens, item_id (the least that has it) of each window of benchmark (item_id, text)."""
    shape = pa.schema([("reading", pa.int32()), ("hash", pa.int64()), ("n", pa.int32()), ("item_id", pa.int64()), ("slots", pa.list_(pa.int64())), ("opens", pa.list_(pa.bool_()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            t, out = Templates(b["text"]), []
            for n, reading, k, h in t.item_windows(window, least):
                slots, opens = t.slots(k, n, reading)
                slots = slots.view(np.int64) if opens.any() else _pattern(slots)
                out.append({"reading": reading, "hash": h, "n": n, "item_id": b["item_id"][int(t.row[k])].as_py(), "slots": slots, "opens": opens})
            yield pa.RecordBatch.from_pylist(out, shape)

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    each = items.mapInArrow(cut, "reading int, hash long, n int, item_id long, slots array<long>, opens array<boolean>")
    return each.groupBy("reading", "hash", "n", "slots", "opens").agg(F.min("item_id").alias("item_id"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, least: int = 6, bound: int = 1_000_000) -> DataFrame:
    """All columns of docs and leaks (replacing a column so named): array of (item_id, start, n) of the matching windows, start in template tokens."""
    docs = docs.drop("leaks")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shape = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
    windows = stage(benchmark_windows(benchmark, window, least), "windows")
    passes = max(1, -(-windows.count() // bound))
    out = docs.withColumn("leaks", F.array().cast("array<struct<item_id: bigint, start: int, n: int>>"))
    for k in range(passes):
        part = windows.filter(F.pmod("hash", F.lit(passes)) == k).toArrow()  # bound windows, give or take chance
        keys, sizes, readings = part["hash"].to_numpy().view(U), part["n"].to_numpy(), part["reading"].to_numpy()
        order = np.lexsort((keys, readings, sizes))
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1) | np.diff(readings[order], prepend=-1)).tolist()
        kinds = [(int(sizes[order[i]]), int(readings[order[i]]), i, j) for i, j in zip(edges, [*edges[1:], len(order)], strict=False)]
        table = (kinds, keys[order], part["item_id"].to_pylist(), part["slots"], part["opens"], order)
        held = docs.sparkSession.sparkContext.broadcast(table)

        def matched(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            kinds, every, items, slots, opens, order = held.value
            for b in text_slices(batches, "text"):
                t, found = Templates(b["text"]), b["leaks"].to_pylist()
                for n, reading, start, stop in kinds:
                    keys = every[start:stop]
                    at, hashes = t.windows(n, reading)
                    left = np.searchsorted(keys, hashes)
                    hits = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == hashes)
                    for i in hits.tolist():
                        own, opened = t.slots(int(at[i]), n, reading)
                        own, first = own.view(np.int64), int(left[i])
                        while first < len(keys) and keys[first] == hashes[i]:
                            k = int(order[start + first])
                            other, first = np.asarray(slots[k].as_py(), np.int64), first + 1
                            if len(other) != len(own):
                                continue
                            fixed = opened | np.asarray(opens[k].as_py(), bool)
                            if (own[fixed] == other[fixed]).all() and consistent(own, other):
                                r = int(t.row[at[i]])
                                found[r].append({"item_id": items[k], "start": int(at[i] - t.bounds[r]), "n": n})
                found = [list({tuple(x.values()): x for x in own}.values()) for own in found]  # several readings of a window count once
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, shape)], b.schema.names)

        out = out.mapInArrow(matched, f"{fields}, leaks array<struct<item_id: bigint, start: int, n: int>>")
        if passes > 1:  # so that no task holds two passes' windows
            out = stage(out, "leaks")
            held.unpersist()
    return out
