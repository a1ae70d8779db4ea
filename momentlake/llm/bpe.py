r"""Byte-level BPE encoding and decoding with a contiguous rank array.

Texts are cut into words by the pattern of byte-level tokenizers files, on the character classes of a few megabytes
at once. Words of up to SHORT bytes are encoded many at a time: a word is a row of parts, at first its bytes, next to
a row of the ranks of adjacent parts; parts lie side by side, so a column's edge is a part boundary. Again and again
each row is scanned for its least rank (the leftmost of equals), the boundary there is deleted, later parts move up,
and the two neighbouring ranks are looked up anew, until no adjacent parts merge. Encoded words are kept in a bounded
table of the task. Longer words merge all places of the least rank at once while these are many, and then one by one
from a heap, so that a word of millions of letters or blanks takes about n log n steps.

The tokenizers file decides on everything: vocabulary, merges, added tokens (taken out of texts before they are cut).
Whether characters younger than Python's Unicode tables are letters, numbers or neither, its library is asked.

Defined cases: a null text is empty and has no ids; rows that repeat are encoded as they come; an empty table gives
no rows; decoding leaves out ids that the file does not have, null ids give an empty text, and bytes that are no
UTF-8 become U+FFFD; columns of the input stay as they are, but those named ids (encode) or decoded (decode) are
replaced. A document is encoded in one task, which holds its words a piece at a time and its ids as 32-bit numbers.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from momentlake.llm._shared import text_slices

SHORT = 64  # bytes of a word that goes through rank arrays
NONE = np.iinfo(np.int32).max
SPACE, LETTER, NUMBER, OTHER, YOUNG = range(5)
_KEPT, _CHARS, _ROWS = 1 << 18, 1 << 20, 1 << 16  # words kept, characters cut at a time, parts in rank arrays at a time
_LATER_GAP = regex.compile(r"(?<=\S)\s")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from U+0100."""
    plain, n, out = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}, 0, []
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + n))
        n += b not in plain
    return out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    r"""The class of each code point: \s, \p{L}, \p{N}, none of them, or YOUNG where Python's Unicode tables do not know it."""
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[[ord(c) for c in every if unicodedata.category(c) == "Cn"]] = YOUNG
    return out


def _asked(c: str) -> int:
    """The class that the tokenizers library gives a character."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return next((kind for x, kind in (("é", LETTER), ("1", NUMBER), ("!", OTHER)) if len(cut(x + c)) == 1), SPACE)


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    r"""Where the words of some texts start; points: the code points of all of them, ends: where each text ends.

    A word is 's 't 're 've 'm 'll or 'd, or a run of letters, numbers or other marks with one blank before it, or white
    space: but its last character, unless the text ends there, belongs to what follows or is a word of its own.
    """
    kind, n = classes()[points], len(points)
    if (young := np.unique(points[kind == YOUNG])).size:
        for c in young.tolist():
            classes()[c] = _asked(chr(c))
        kind = classes()[points]
    edge = np.ones(n + 1, bool)  # a run of one class, or a text, starts
    edge[1:n] = kind[1:] != kind[:-1]
    edge[ends] = True
    run, space = edge[:n], kind == SPACE
    start = run.copy()
    last = space & edge[1:]
    last[ends[ends > 0] - 1] = False
    start |= last
    text_start = np.zeros(n + 1, bool)
    text_start[ends] = text_start[0] = True
    joined = np.zeros(n, bool)
    joined[1:] = run[1:] & ~space[1:] & (points[:-1] == 0x20) & ~text_start[1:n]
    start &= ~joined
    quote = np.flatnonzero((points == 0x27) & run & edge[1:] & ~joined & ~text_start[1:])  # alone among marks, no blank before it, more text after it
    quote = quote[kind[quote + 1] == LETTER]
    one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
    pair = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[pair & (one == ord(a)) & (two == ord(b))] = 2
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + 1 + size
    start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Codec:
    """Encodes and decodes as the library of the tokenizers file does, for byte-level BPE files without a normalizer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, added = spec["model"], spec["pre_tokenizer"] or {}, spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        wrong = odd or model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
        if wrong or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocabulary, letters = model["vocab"], byte_characters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_ids = np.array([vocabulary[c] for c in letters], np.int32)
        left, right = (np.array([vocabulary[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, NONE).astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        made = np.full(max(max(vocabulary.values()), *(t["id"] for t in added), 0) + 1, -1)
        made[self.merged] = np.arange(len(merges))
        self.in_order = bool((np.maximum(made[left], made[right]) < np.arange(len(merges))).all())  # no merge makes one of lower rank possible
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.bytes_of = [b""] * len(made)
        for token, i in chain(vocabulary.items(), ((t["content"], t["id"]) for t in added)):
            known = all(c in byte_of for c in token)
            self.bytes_of[i] = b"".join(byte_of[c] for c in token) if known else token.encode()
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.kept: dict[bytes, tuple[int, ...]] = {}

    # merges

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = tuple(self.encode_long(w).tolist())
            elif w:
                by_size.setdefault(len(w), []).append(k)
        for size, own in by_size.items():
            for k in range(0, len(own), _ROWS // size):
                some = own[k : k + _ROWS // size]
                data = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(-1, size)
                for row, ids in self._encode_rows(self.byte_ids[data]):
                    for i, x in zip(row.tolist(), ids.tolist(), strict=True):
                        out[some[i]] = tuple(x)
        return out

    def _encode_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and ids of words of one length as they are done; every round deletes one boundary of each word that is left."""
        row, ranks = np.arange(len(parts)), self._rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            n = parts.shape[1]
            if n == 1:
                yield row, parts
                return
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            if not (more := least != NONE).all():
                yield row[~more], parts[~more]
                row, parts, ranks, at, least = row[more], parts[more], ranks[more], at[more], least[more]
            each, columns = np.arange(len(row)), np.arange(n - 1)
            parts = parts[each[:, None], columns + (columns > at[:, None])]  # the part after the boundary goes
            parts[each, at] = self.merged[least]
            columns = columns[:-1]
            ranks = ranks[each[:, None], columns + (columns >= at[:, None])]
            if n > 2:
                for beside in (at - 1, at):
                    own = np.flatnonzero((beside >= 0) & (beside < n - 2))
                    ranks[own, beside[own]] = self._rank(parts[own, beside[own]], parts[own, beside[own] + 1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)]
        while self.in_order and len(parts) > 1:
            ranks = self._rank(parts[:-1], parts[1:])
            least = ranks.min()
            if least == NONE:
                return parts
            at = np.flatnonzero(ranks == least)
            if len(at) * 64 < len(parts):
                break
            new = np.concatenate([[True], np.diff(at) > 1])  # of overlapping places every second one merges
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(new, nth, 0))) % 2 == 0]
            parts[at] = self.merged[least]
            parts = np.delete(parts, at + 1)
        return self._from_heap(parts)

    def _from_heap(self, parts: np.ndarray) -> np.ndarray:
        n, p = len(parts), parts.tolist()
        after, prior, merged, rank_of = list(range(1, n + 1)), list(range(-1, n - 1)), self.merged.tolist(), self.rank_of
        ranks = self._rank(parts[:-1], parts[1:]).astype(np.int64)
        heap = (ranks[ranks != NONE] << 32 | np.flatnonzero(ranks != NONE)).tolist()
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if p[i] < 0 or j >= n or rank_of.get(p[i] << 32 | p[j]) != rank:
                continue
            p[i], p[j], k = merged[rank], -1, after[j]
            after[i] = k
            if k < n:
                prior[k] = i
            for a, b in ((prior[i], i), (i, k)):
                if a >= 0 and b < n and (r := rank_of.get(p[a] << 32 | p[b])) is not None:
                    heapq.heappush(heap, r << 32 | a)
        return np.array([x for x in p if x >= 0], np.int32)

    # texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; about _CHARS characters are cut to words at a time."""
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in texts]
        held: list[str] = []
        owner: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            for piece in self._pieces(text):
                if isinstance(piece, str):
                    held.append(piece)
                    owner.append(k)
                    size += len(piece)
                if size >= _CHARS or not isinstance(piece, str):
                    self._add(out, owner, held)
                    held, owner, size = [], [], 0
                if not isinstance(piece, str):
                    out[k].append(np.array([piece], np.int32))
        self._add(out, owner, held)
        return [np.concatenate(x) for x in out]

    def _pieces(self, text: str) -> Iterator[str | int]:
        """A text's added tokens, as ids, and what lies between them, cut before white space where it is long."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield self.added[part]
                continue
            at = 0
            while len(part) - at > 2 * _CHARS and (gap := _LATER_GAP.search(part, at + _CHARS)):
                yield part[at : gap.start()]
                at = gap.start()
            if at < len(part):
                yield part[at:] if at else part

    def _add(self, out: list[list[np.ndarray]], owner: list[int], texts: list[str]) -> None:
        """Adds the ids of texts without added tokens to those of their owners."""
        if not texts:
            return
        whole = "".join(texts)
        points, ends = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.cumsum([len(t) for t in texts])
        starts = word_starts(points, ends)
        widths = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            widths += points >= least
        bytes_at = np.concatenate([[0], np.cumsum(widths)])
        offsets = np.append(bytes_at[starts], bytes_at[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())]).dictionary_encode()
        distinct, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        known = [self.kept.get(w) for w in distinct]
        new = [k for k, ids in enumerate(known) if ids is None]
        for k, ids in zip(new, self.encode_words([distinct[k] for k in new]), strict=True):
            known[k] = ids
        if len(self.kept) + len(new) > _KEPT:
            self.kept.clear()
        self.kept.update((distinct[k], known[k]) for k in new[:_KEPT] if len(distinct[k]) <= SHORT)
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat, first = np.fromiter(chain.from_iterable(known), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes
        counts = sizes[which]
        upto = np.cumsum(counts)
        ids = flat[np.arange(upto[-1]) + np.repeat(first[which] - upto + counts, counts)]
        cuts = np.searchsorted(starts, ends)
        for k, a, b in zip(owner, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            out[k].append(ids[upto[a - 1] if a else 0 : upto[b - 1] if b else 0])

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.bytes_of))]
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _fields(df: DataFrame, without: str) -> tuple[DataFrame, str]:
    df = df.drop(without)
    return df, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of docs with ids array<int>: the token ids of the column text, without any that the file adds around texts."""
    path = tokenizer or default_tokenizer()
    docs, fields = _fields(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in text_slices(batches, "text", 2 << 20):
            ids = own.encode([t.as_py() or "" for t in b["text"]])
            ends = np.cumsum([0, *map(len, ids)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, "ids"])

    return docs.mapInArrow(run, fields + "ids array<int>")


def decode(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of tokens with decoded string: the text of the column ids, special tokens included."""
    path = tokenizer or default_tokenizer()
    tokens, fields = _fields(tokens, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [own.decode(np.asarray(x.values.drop_null().cast(pa.int32())) if x.is_valid else np.zeros(0, np.int32)) for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return tokens.mapInArrow(run, fields + "decoded string")
