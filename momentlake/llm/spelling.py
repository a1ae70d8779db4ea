r"""Spelling variants: words that differ by one code point, and for each rare one the frequent word that it is a form of.

Words are counted in the tasks that read them (a run of letters, lower-cased in A-Z; a task sends each of its words
once or a few times). Two near words, the shorter of n code points, agree before the first place i where they differ
and after it. So words are listed by n (their own length, or one less) and by a range of places [a, b) for i, under
the key of what near words then share: the first a and the last n - b code points. There are two ranges at first, and
where a key has more than LIST_BYTES of words its range is halved until it is one place, where a key has at most
some thousands of words, as all but two of their letters are the same. Every pair of near words is met under one key
only, that with i in its range and the shorter word's n.

A key's words are a sorted list (of reversed words where they share more of the end than of the beginning) that is
scanned by all of its words at once: words with a common prefix are a range of the list, which the lengths of adjacent
common prefixes delimit, and a query has one row of the edit matrix, of the three cells next to the diagonal, for each
range. It is computed from the row of the range one letter shorter, and once all three cells exceed one edit the range
is skipped with all its words. What all words of the list share is never computed. The task sends each word's number
of near words and its best one.

Defined cases: null texts have no words; a null doc_id is the empty text in what is hashed; rows that repeat count as
often as they occur; runs of any length are words, and a task holds the words of one key, by LIST_BYTES; an empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import stage, text_slices
from momentlake.llm._words import buffers, lowered, word_spans

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
LIST_BYTES, QUERIES, _HELD = 1 << 18, 1 << 13, 1 << 18
FAR = 2  # edits beyond the one that counts

#: crc32 state of the row's key, run (lower-cased, UTF-8) -> the word that is counted for it.
Change = Callable[[int, bytes], bytes]


def no_change(_: int, run: bytes) -> bytes:
    return run


def drop_one_of(every: int) -> Change:
    """Deletes one code point of the runs whose crc32, after that of the row's key, is divisible by `every`."""

    def change(state: int, run: bytes) -> bytes:
        h = zlib.crc32(run, state)
        if h % every:
            return run
        text = run.decode()
        at = h % len(text)
        return (text[:at] + text[at + 1 :]).encode()

    return change


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Change = no_change) -> DataFrame:
    """word, n: the words of at least least_length code points with at least least_count occurrences in docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in text_slices(batches, "text", 4 << 20):
            data, offsets = buffers(b["text"])
            data = lowered(data)
            wide = data == 0xC3  # the first byte of U+00C0 to U+00FF
            inside = (data >= 0x61) & (data <= 0x7A) | wide
            inside[1:] |= wide[:-1]
            starts, ends, row = word_spans(data, offsets, inside)
            before = np.concatenate([[0], np.cumsum(wide)])
            long = ends - starts - (before[ends] - before[starts]) >= least_length
            starts, ends, row = starts[long], ends[long], row[long]
            if not len(starts):
                continue
            edges = np.empty(2 * len(starts), np.int64)
            edges[::2], edges[1::2] = starts, ends
            runs = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
            runs = runs.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
            distinct = runs.dictionary.to_pylist()
            pairs, times = np.unique(row * len(distinct) + runs.indices.to_numpy(), return_counts=True)
            states = [zlib.crc32(f"{'' if k is None else k}:".encode()) for k in b["doc_id"].to_pylist()]
            for k, word, n in zip((pairs // len(distinct)).tolist(), (pairs % len(distinct)).tolist(), times.tolist(), strict=True):
                run = distinct[word]
                if (new := change(states[k], run)) is not run and len(new.decode()) < least_length:
                    continue
                total[new] = total.get(new, 0) + n
            if len(total) > _HELD:
                yield flush()
        yield flush()

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _key(a: Column, b: Column) -> Column:
    n = F.col("size")
    return F.concat_ws("\x1f", n, a, b, F.substring("word", F.lit(1), a), F.when(n > b, F.right("word", n - b)).otherwise(""))


def _listed(words: DataFrame, list_bytes: int) -> DataFrame:
    """key, size (n), a, b, word, n: words under the keys of the ranges for their first difference."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    shortest = words.agg(F.min(F.length("word"))).first()[0] or 0
    each = words.select("word", "n", sizes).filter(F.col("size") >= shortest)
    todo, done = _halved(each.withColumns({"a": F.lit(0), "b": F.col("size") + 1})), []
    while True:
        todo = stage(todo, "listed")
        large = todo.groupBy("key", "size", "a", "b").agg(F.count("*").alias("rows")).filter((F.col("rows") * F.col("size") > list_bytes) & (F.col("b") - F.col("a") > 1))
        large = stage(large.select("key"), "large")  # at most a key for each list_bytes of what is listed
        if large.isEmpty():
            break
        done.append(todo.join(large, "key", "left_anti"))
        todo = _halved(todo.join(large, "key", "left_semi"))
    for x in done:
        todo = todo.unionByName(x)
    return todo


def _halved(listed: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))).alias("h")
    out = listed.select("word", "n", "size", halves).select("word", "n", "size", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    return out.select(_key(F.col("a"), F.col("b")).alias("key"), "size", "a", "b", "word", "n")


def _backwards(size: Column, a: Column, b: Column) -> Column:
    return a < size - b


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of letters (one byte each; 0 after the end, two more columns) for each word, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0)) + 2
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width), sizes


def scan(x: np.ndarray, sizes: np.ndarray, first: np.ndarray, until: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, word) of words that are one edit apart. x: letters of sorted lists, one list after the other;
    first and until: where a row's list starts and ends; shared: how many letters all words of its list begin with."""
    rows, width = x.shape
    same = np.cumprod(x[1:] == x[:-1], axis=1, dtype=np.uint8).sum(1) if rows > 1 else np.zeros(0, np.int64)
    lcp = np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])
    lcp[first] = 0
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    heads = {}  # by depth: where ranges with one more common letter start
    for at in range(0, rows, QUERIES):
        every = np.arange(at, min(rows, at + QUERIES))
        for depth in np.unique(shared[every]).tolist():
            query = every[shared[every] == depth]
            low, high = first[query], until[query]
            left = np.full(len(query), 1 if depth else FAR, np.int8)
            middle, right = np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
            while len(query):
                whole = np.flatnonzero(sizes[low] == depth)  # words that end here come first in their range
                short = sizes[query[whole]] - depth
                edits = np.select([short == -1, short == 0, short == 1], [left[whole], middle[whole], right[whole]], FAR)
                found.append((query[whole[edits == 1]], low[whole[edits == 1]]))
                if depth not in heads:
                    heads[depth] = np.append(np.flatnonzero((lcp <= depth) & (sizes > depth)), rows)
                head = heads[depth]
                a, b = np.searchsorted(head, low), np.searchsorted(head, high)
                count = b - a
                parent = np.repeat(np.arange(len(query)), count)
                which = np.arange(len(parent)) + np.repeat(a - (np.cumsum(count) - count), count)
                query, l, m, r = query[parent], left[parent], middle[parent], right[parent]  # noqa: E741
                low, high = head[which], np.minimum(head[np.minimum(which + 1, len(head) - 1)], high[parent])
                letter = x[low, depth]
                left = np.minimum(l + (letter != x[query, depth - 1]) if depth else FAR, m + 1)
                middle = np.minimum(np.minimum(m + (letter != x[query, depth]), r + 1), left + 1)
                right = np.minimum(r + (letter != x[query, np.minimum(depth + 1, width - 1)]), middle + 1)
                depth += 1
                near = np.flatnonzero(np.minimum(np.minimum(left, middle), right) < FAR)
                query, low, high, left, middle, right = query[near], low[near], high[near], left[near], middle[near], right[near]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def near_words(words: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """word, n_near, best_n, best: of words (word, n) that have near words their number, and the most frequent (ties: least) one."""
    columns = ["key", "size", "a", "b", "word", "n"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            at = 0
            lengths = b["size"].to_numpy()
            while at < b.num_rows:
                keys = b["key"]
                if size >= list_bytes:  # up to the end of the last key
                    last = held[-1]["key"][-1].as_py()
                    stop = at
                    while stop < b.num_rows and keys[stop].as_py() == last:
                        stop += 1
                    held.append(b.slice(at, stop - at))
                    if stop < b.num_rows:
                        yield _near(pa.Table.from_batches(held))
                        held, size = [], 0
                    at = stop
                    continue
                room = np.searchsorted(np.cumsum(lengths[at:] + 1), list_bytes - size) + 1
                held.append(b.slice(at, room))
                size += int((lengths[at : at + room] + 1).sum())
                at += room
        if held:
            yield _near(pa.Table.from_batches(held))

    size, a, b = F.col("size"), F.col("a"), F.col("b")
    order = F.when(_backwards(size, a, b), F.reverse("word")).otherwise(F.col("word"))
    lists = _listed(words, list_bytes).repartition("key").sortWithinPartitions("size", "key", order)
    part = lists.select(*columns).mapInArrow(near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def _near(lists: pa.Table) -> pa.RecordBatch:
    """What some whole lists say of their words."""
    words = [w.encode("latin-1") for w in lists["word"].to_pylist()]
    n, size, a, b = (lists[c].to_numpy() for c in ("n", "size", "a", "b"))
    codes = lists["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    start = np.flatnonzero(np.concatenate([[True], np.diff(codes) != 0]))
    ends = np.append(start[1:], len(codes))
    of = np.repeat(np.arange(len(start)), ends - start)
    x, sizes = letters_of(words)
    back = a < size - b
    at = np.arange(x.shape[1])
    turned = np.where(at < sizes[:, None], x[np.arange(len(x))[:, None], np.maximum(sizes[:, None] - 1 - at, 0)], 0)
    query, word = scan(np.where(back[:, None], turned, x), sizes, start[of], ends[of], np.where(back, size - b, a))
    ok = np.minimum(sizes[query], sizes[word]) == size[query]
    query, word = query[ok], word[ok]
    place = np.cumprod(x[query] == x[word], axis=1, dtype=np.uint8).sum(1)
    place = np.minimum(place, size[query])
    ok = (place >= a[query]) & (place < b[query])
    query, word = query[ok], word[ok]
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, f"S{x.shape[1]}"), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[word], -n[word], query))
    query, word = query[order], word[order]
    top = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0])[: len(query)])
    counts = np.diff(np.append(top, len(query)))
    return pa.RecordBatch.from_arrays(
        [lists["word"].combine_chunks().take(pa.array(query[top])), pa.array(counts, pa.int64()), pa.array(n[word[top]], pa.int64()), lists["word"].combine_chunks().take(pa.array(word[top]))],
        ["word", "n_near", "best_n", "best"],
    )


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of forms (word, form): the last word that forms lead to, in at most `most` steps; each round doubles the steps."""
    known = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(most, 1)))):
        further = known.select(F.col("word").alias("via"), F.col("root").alias("further"))
        known = stage(known.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return known


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, change: Change = no_change, list_bytes: int = LIST_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (doc_id, text).

    form: the near word of largest n (ties: the least in code-point order), if that n is at least ratio times the
    word's, else null; root: where forms lead to from the word, the word itself if it has none.
    """
    words = stage(vocabulary(docs, least_length, least_count, change), "vocabulary")
    most = words.agg(F.max("n")).first()[0] or 1
    near = words.join(near_words(words, list_bytes), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    near = stage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    steps = max(1, int(math.log(max(most / least_count, 1), ratio)) + 1)  # each step multiplies n by ratio at least
    own = roots(near.filter("form is not null"), steps)
    return near.join(own, "word", "left").withColumn("root", F.coalesce("root", "word"))
