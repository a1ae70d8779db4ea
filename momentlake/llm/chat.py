r"""Chat formatting by token-level assembly.

A turn is a marker with the role, the text, and an end marker. Markers are reserved ids just above the
vocabulary; texts are encoded on their own and the ids are spliced together, so no text can spell a marker.
In texts, every \, # and < gets a \ before it, so that the rendered string has control strings (### and
</turn>) only where the template put them; unescape() is the exact inverse. The loss mask is the prefix sum
of +1 where an assistant text starts and -1 where it ends.

A conversation comes as one or more rows ("chunks"): rows are dealt by ranges of (conv_id, turn), so that a
conversation of any length is formatted by as many tasks as it needs; `chunk` orders them.

Defined cases: turns go by (turn, role, text), nulls first; a null text or role is empty; roles other than
user, assistant, system and tool are spelled out between two markers; a null conv_id is a conversation of
its own; white space of any length is text like any other; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
RENDERED = {**{r: f"### {r.capitalize()}: " for r in ROLES}, "role": "### Role ", "colon": ": ", "end": "</turn>\n"}
CHUNK_TURNS, CHUNK_CHARS = 512, 1 << 20
LONG_GAP = 100_000  # white-space characters in a row that are encoded on their own


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\#<])", r"\1", text)


@lru_cache(maxsize=8)
def encoding(path: str, special: tuple[tuple[str, int], ...] = (), pattern: str | None = None):  # noqa: ANN201
    """The byte-level BPE of a .tiktoken ranks file, with special tokens (text, id); pattern: another than its own for words."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def encode_text(path: str, text: str, special: tuple[tuple[str, int], ...] = ()) -> list[int]:
    """The ids of a text, special tokens in it included.

    The library's pattern engine gives up on about a million white-space characters in a row. Where there are LONG_GAP
    of them, they are encoded as the one word that the pattern makes of them: all but the last, which goes with what
    follows, or all at the end of the text.
    """
    enc, known, out, at = encoding(path, special), {x for x, _ in special}, [], 0
    if len(text) > LONG_GAP:
        for gap in regex.finditer(r"\s+", text):
            if gap.end() - gap.start() > LONG_GAP:
                end = gap.end() - (gap.end() < len(text))
                out += enc.encode(text[at : gap.start()], allowed_special=known, disallowed_special=())
                out += encoding(path, (), r"(?s).+").encode_ordinary(text[gap.start() : end])
                at = end
    return out + enc.encode(text[at:] if at else text, allowed_special=known, disallowed_special=())


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Template:
    """Ids of the markers, and turns to ids and back."""

    def __init__(self, path: str) -> None:
        self.path, self.enc = path, encoding(path)
        first = self.enc.max_token_value + 2  # one id is left to the vocabulary's own end-of-text
        self.ids = {name: first + i for i, name in enumerate(RENDERED)}
        self.names = {i: name for name, i in self.ids.items()}
        self.first = first

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        parts, at, marks = [], 0, []
        for role, text in turns:
            body = encode_text(self.path, escape(text))
            head = [self.ids[role]] if role in ROLES else [self.ids["role"], *encode_text(self.path, escape(role)), self.ids["colon"]]
            at += len(head)
            if role == "assistant":
                marks += [(at, 1), (at + len(body), -1)]
            at += len(body) + 1
            parts += [head, body, [self.ids["end"]]]
        ids = np.fromiter((x for p in parts for x in p), np.int32, at)
        delta = np.zeros(at + 1, np.int32)
        if marks:
            where, what = zip(*marks, strict=True)
            np.add.at(delta, list(where), list(what))
        return ids, np.cumsum(delta)[:at].astype(np.int8)

    def segments(self, ids: np.ndarray) -> Iterator[tuple[str | None, int, int]]:
        """(marker, its place, place after it) and, between markers, (None, start, end)."""
        last = 0
        for k in np.flatnonzero(ids >= self.first).tolist():
            if k > last:
                yield None, last, k
            yield self.names[int(ids[k])], k, k + 1
            last = k + 1

    def decode(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids.tolist()).decode("utf-8")

    def read(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, list[str], int]]:
        """Role, text, texts under the mask and rendered length of each turn."""
        role, text, spelled, loss, chars = "", "", False, [], 0
        for name, a, b in self.segments(ids):
            if name is None:
                raw = self.decode(ids[a:b])
                chars += len(raw)
                if spelled:
                    role = unescape(raw)
                else:
                    text = unescape(raw)
                    for run in np.split(np.arange(a, b), np.flatnonzero(np.diff(mask[a:b])) + 1):
                        if mask[run[0]]:
                            loss.append(unescape(self.decode(ids[run[0] : run[-1] + 1])))
                continue
            chars += len(RENDERED[name])
            if name == "end":
                yield role, text, loss, chars
                role, text, spelled, loss, chars = "", "", False, [], 0
            elif name == "role":
                spelled = True
            elif name == "colon":
                spelled = False
            else:
                role = name

    def render(self, ids: np.ndarray) -> str:
        return "".join(RENDERED[name] if name else self.decode(ids[a:b]) for name, a, b in self.segments(ids))


def format_chat(turns: DataFrame, ranks: str | None = None) -> DataFrame:
    """conv_id, chunk, n_turns, formatted string, ids array<int>, loss_mask array<tinyint> of turns (conv_id, turn, role, text)."""
    ranks = ranks or default_ranks()
    order = ["conv_id", "turn", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, base, n = Template(ranks), TaskContext.get().partitionId() << 32, 0
        conv, held, chars = None, [], 0

        def flush() -> pa.RecordBatch:
            ids, mask = template.assemble(held)
            return pa.RecordBatch.from_pydict({"conv_id": [conv], "chunk": [base + n], "n_turns": [len(held)], "formatted": [template.render(ids)], "ids": pa.array([ids], pa.list_(pa.int32())), "loss_mask": pa.array([mask], pa.list_(pa.int8()))}, schema)

        for b in batches:
            for c, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"], strict=True):
                if held and (c != conv or len(held) >= CHUNK_TURNS or chars >= CHUNK_CHARS):
                    yield flush()
                    held, chars, n = [], 0, n + 1
                conv = c
                held.append((role or "", text.as_py() or ""))
                chars += len(held[-1][1])
        if held:
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    keys = ["conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64))]  # ranges of these are ranges of the whole order
    return rows.repartitionByRange(*keys).sortWithinPartitions(*order).mapInArrow(assemble, "conv_id long, chunk long, n_turns long, formatted string, ids array<int>, loss_mask array<tinyint>")


def read_chunks(formatted: DataFrame, ranks: str | None = None) -> DataFrame:
    """conv_id, chunk, n_turns, turns (role, newline, text, newline of each), loss (the texts under the mask), loss_chars, formatted_chars of format_chat()'s chunks, from ids and masks."""
    ranks = ranks or default_ranks()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(ranks)
        for b in batches:
            for c, chunk, ids, mask in zip(b["conv_id"], b["chunk"], b["ids"], b["loss_mask"], strict=True):
                turns = list(template.read(ids.values.to_numpy(), mask.values.to_numpy()))
                loss = "".join(x for _, _, texts, _ in turns for x in texts)
                yield pa.RecordBatch.from_pydict({
                    "conv_id": pa.array([c.as_py()], pa.int64()), "chunk": [chunk.as_py()], "n_turns": [len(turns)], "turns": ["".join(f"{role}\n{text}\n" for role, text, _, _ in turns).encode()],
                    "loss": [loss.encode()], "loss_chars": [len(loss)], "formatted_chars": [sum(t[3] for t in turns)],
                })

    return formatted.select("conv_id", "chunk", "ids", "loss_mask").mapInArrow(read, "conv_id long, chunk long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long")


def read_back(formatted: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per conversation of format_chat()'s ids and masks: counts and digests of its turns and of the text under the mask.

    Chunks are decoded where they are. The digests are sequential by nature: a conversation's decoded chunks stream
    through one task in order, which only hashes them and holds one chunk at a time.
    """
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> dict:
            return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            done = []
            for c, n, turns, loss, loss_chars, chars in zip(*(b[x] for x in ("conv_id", "n_turns", "turns", "loss", "loss_chars", "formatted_chars")), strict=True):
                if state is None or c.as_py() != conv:
                    if state is not None:
                        done.append(row())
                    conv, state = c.as_py(), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n.as_py()
                state[1].update(turns.as_buffer())
                state[2] += loss_chars.as_py()
                state[3].update(loss.as_buffer())
                state[4] += chars.as_py()
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    rows = read_chunks(formatted, ranks).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return rows.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
