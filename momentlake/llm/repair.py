r"""Repair of conversations at least cost, by Four-Russians block tables.

A row (turn, role, text) of a conversation is a symbol: what its role's first letter is (s, u, a or another) and
whether it has to go (blank, or role and text seen earlier), is truncated (does not end in . ! or ?) or is sound. Edits
turn the rows into a conversation whose roles' first letters are (s?(ua)+)?: keep (0), rerole to user or assistant
(1), delete (2), insert an empty user or assistant (5); truncated rows that stay cost 5 more. What the rest of a
conversation costs from each of the four states (nothing yet, after s, u, a) is a cost vector; less its least
component it is one of a few dozen. For each of these and each block of BLOCK symbols a table holds the vector before
the block and the cost between: rows are gone through from the last block to the first, a lookup each. Going back over
the blocks, from the first to the last, each is expanded to the vectors at its symbols, and from the state reached
the edit least in ASCII of those that meet the least cost is taken; as a state and an edit give one next state, the
whole audit is the least of all cheapest ones.

A conversation of any length is cut into chunks of rows, in ranges of (conv_id, turn, role, text). A chunk's rows are
judged and expanded where they are. Of conversations of more than one chunk, first occurrences of rows are settled by
the digests of each chunk's distinct rows, and a task sees for each chunk one map of cost vectors, to tell the chunk
its last vector and first state. Audits and repaired texts of a conversation then stream through one task in order,
which hashes them and holds its audit (a letter a row, which the result has in one row).

Defined cases: null roles and texts are one blank; rows go by (turn, role, text), null turns first; equal rows of one
turn count as often as they occur, though they travel once with their number; an empty role has no first letter and
fits no place; a null conv_id is a conversation of its own; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm._shared import stage

START, S, U, A = range(4)
NEXT = (U, U, A, U)  # the state after an inserted or reroled turn
KEPT = {(START, 0): S, (START, 1): U, (S, 1): U, (U, 2): A, (A, 1): U}  # (state, first letter) of turns that may stay
GONE, AGAIN = 8, 9  # symbols: first letter + 4 if truncated; blank; seen earlier (counts as GONE in the tables)
SYMBOLS = 9
BLOCK, CHUNK_ROWS, CHUNK_CHARS = 4, 1024, 1 << 20
ROLES = {U: "user", A: "assistant"}
LEGAL = frozenset({(0, 1), (1, 2), (2, 1)})
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Tables:
    """Cost vectors, and for each vector after a symbol or block the vector before it and the cost between."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs
        end = self._closed([0, None, None, 0])
        self.vectors, self.number = [end], {end: 0}
        nexts, offsets = [], []
        for v in self.vectors:  # grows as it goes
            row = [self.before(v, s) for s in range(SYMBOLS)]
            for w, _ in row:
                if w not in self.number:
                    self.number[w] = len(self.vectors)
                    self.vectors.append(w)
            nexts.append([self.number[w] for w, _ in row])
            offsets.append([c for _, c in row])
        self.next, self.offset = np.array(nexts), np.array(offsets)
        before, cost = self.next, self.offset
        for _ in range(BLOCK - 1):  # one more symbol in front
            before, cost = (np.swapaxes(x, 1, 2).reshape(len(before), -1) for x in (self.next[before], cost[:, :, None] + self.offset[before]))
        self.block_next, self.block_offset = before, cost
        self.powers = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        self.expanded: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def _closed(self, v: list[int | None]) -> tuple[int, ...]:
        """v with insertions before what follows."""
        for _ in range(4):
            for q in range(4):
                if v[NEXT[q]] is not None and (v[q] is None or v[q] > v[NEXT[q]] + self.costs.insert):
                    v[q] = v[NEXT[q]] + self.costs.insert
        return tuple(v)

    def options(self, q: int, symbol: int) -> list[tuple[str, int, int]]:
        """Edit, cost and next state of the edits of a row in a state, in ASCII order."""
        out = [("D", self.costs.delete, q)]
        if symbol < GONE:
            more = self.costs.truncated if symbol >= 4 else 0
            if (q, symbol % 4) in KEPT:
                out.append(("K", more, KEPT[q, symbol % 4]))
            out.append(("R", self.costs.rerole + more, NEXT[q]))
        return out

    def before(self, v: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        """The vector before a symbol, less its least component, and that."""
        full = self._closed([min(c + v[to] for _, c, to in self.options(q, symbol)) for q in range(4)])
        return tuple(x - min(full) for x in full), min(full)

    def codes(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """The first symbols, fewer than BLOCK, and the numbers of the blocks after them."""
        head = len(symbols) % BLOCK
        return symbols[:head].tolist(), (symbols[head:].reshape(-1, BLOCK) @ self.powers).tolist()

    def back(self, head: list[int], blocks: list[int], last: int) -> tuple[list[int], int]:
        """Vector numbers after each symbol of head and each block (before all of them first), and the cost between, from the last vector."""
        seen, cost, v = [last], 0, last
        for code in reversed(blocks):
            cost += int(self.block_offset[v, code])
            v = int(self.block_next[v, code])
            seen.append(v)
        for s in reversed(head):
            cost += int(self.offset[v, s])
            v = int(self.next[v, s])
            seen.append(v)
        return seen[::-1], cost

    def expand(self, code: int, size: int, last: int, q: int) -> tuple[str, int]:
        """The least edits of a block (of `size` symbols) that starts in state q, before vector `last`, and the state after it. Each row ends in D, K or R."""
        key = (code, size, last, q)
        if key not in self.expanded:
            symbols = [code // SYMBOLS**k % SYMBOLS for k in range(size - 1, -1, -1)]
            vectors, audit = [(self.vectors[last], 0)], ""
            for s in reversed(symbols):
                vectors.append(self.before(vectors[-1][0], s))
            vectors.reverse()
            for s, (here, off), (after, _) in zip(symbols, vectors, vectors[1:], strict=False):
                done = False
                while not done:
                    now = here[q] + off
                    choices = [(e, to, True) for e, c, to in self.options(q, s) if c + after[to] == now]
                    if here[NEXT[q]] + off + self.costs.insert == now:
                        choices.append(("I", NEXT[q], False))
                    edit, q, done = min(choices)
                    audit += edit
            self.expanded[key] = (audit, q)
        return self.expanded[key]

    def trace(self, symbols: np.ndarray, last: int, q: int) -> tuple[list[str], int]:
        """The least edits of each block of symbols from state q on, and the state after them."""
        head, blocks = self.codes(symbols)
        seen, _ = self.back(head, blocks, last)
        out = []
        for code, size, v in zip([*head, *blocks], [1] * len(head) + [BLOCK] * len(blocks), seen[1:], strict=True):
            audit, q = self.expand(code, size, v, q)
            out.append(audit)
        return out, q

    def closing(self, q: int) -> str:
        """Insertions after the last row."""
        return "I" * ((self.vectors[0][q] - self.vectors[0][START]) // self.costs.insert)


@lru_cache(maxsize=4)
def tables(costs: Costs) -> Tables:
    return Tables(costs)


def symbol(role: str, text: str) -> int:
    last = _LAST.search(text)
    if not last:
        return GONE
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (0 if last[0] in ".!?" else 4)


def _digest(role: str, text: str) -> bytes:
    head = role.encode()
    return hashlib.blake2b(len(head).to_bytes(8, "little") + head + text.encode(), digest_size=16).digest()


@lru_cache
def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(","))])


_CHUNK = "conv_id long, chunk long, turns array<long>, roles array<string>, texts array<string>, copies array<long>, letters binary, symbols binary, digests binary"


def _chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) in chunks of a conversation, in order. Rows that a chunk has twice are AGAIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        conv, held, chars = None, [], 0

        def flush() -> dict:
            turns, roles, texts, copies = map(list, zip(*held, strict=True))
            seen, symbols, digests = set(), bytearray(), [_digest(r, t) for r, t in zip(roles, texts, strict=True)]
            for role, text, d in zip(roles, texts, digests, strict=True):
                symbols.append(AGAIN if (x := symbol(role, text)) != GONE and d in seen else x)
                seen.add(d)
            letters = bytes({"s": 0, "u": 1, "a": 2}.get(r[:1], 3) for r in roles)
            return {"conv_id": conv, "chunk": base + n, "turns": turns, "roles": roles, "texts": texts, "copies": copies, "letters": letters, "symbols": bytes(symbols), "digests": b"".join(digests)}

        done, size = [], 0  # chunks leave some at a time
        for b in batches:
            for c, *row in zip(b["conv_id"].to_pylist(), b["turn"].to_pylist(), b["role"].to_pylist(), b["text"], b["copies"].to_pylist(), strict=True):
                row[2] = row[2].as_py()
                if held and (c != conv or len(held) >= chunk_rows or chars >= CHUNK_CHARS):
                    done.append(flush())
                    held, chars, n, size = [], 0, n + 1, size + chars
                    if size >= CHUNK_CHARS:
                        yield pa.RecordBatch.from_pylist(done, _arrow(_CHUNK))
                        done, size = [], 0
                conv = c
                held.append(row)
                chars += len(row[2])
        if held:
            yield pa.RecordBatch.from_pylist([*done, flush()], _arrow(_CHUNK))

    return rows.mapInArrow(run, _CHUNK)


def _settled(symbols: bytes, digests: bytes, seen: list[bytes] | None) -> np.ndarray:
    """A chunk's symbols once rows of earlier chunks (their digests) are known."""
    out = np.frombuffer(symbols, np.uint8).copy()
    if seen:
        seen = set(seen)
        for k in np.flatnonzero(out < GONE).tolist():
            if digests[16 * k : 16 * k + 16] in seen:
                out[k] = AGAIN
    return out


def _seen_earlier(chunks: DataFrame) -> DataFrame:
    """chunk, seen: the digests of a chunk's rows that earlier chunks of its conversation have."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, chunk, symbols, digests in zip(*(b[c].to_pylist() for c in ("conv_id", "chunk", "symbols", "digests")), strict=True):
                own = [digests[16 * k : 16 * k + 16] for k, s in enumerate(symbols) if s != AGAIN]
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv] * len(own), pa.int64()), "chunk": pa.array([chunk] * len(own), pa.int64()), "digest": pa.array(own, pa.binary())})

    each = chunks.select("conv_id", "chunk", "symbols", "digests").mapInArrow(first, "conv_id long, chunk long, digest binary")
    earliest = each.groupBy(F.col("conv_id").alias("own"), F.col("digest").alias("known")).agg(F.min("chunk").alias("least"), F.count("*").alias("n")).filter("n > 1")
    later = each.join(earliest, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("known"))).filter("chunk > least")
    return later.groupBy("chunk").agg(F.collect_list("digest").alias("seen"))  # a chunk's own rows at most


def _plans(chunks: DataFrame, costs: Costs) -> DataFrame:
    """chunk, last, first: the vector after a chunk and the state before it, of chunks with seen, for conversations of several chunks."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(costs)
        for b in batches:
            out = []
            for symbols, digests, seen in zip(*(b[c].to_pylist() for c in ("symbols", "digests", "seen")), strict=True):
                x = np.minimum(_settled(symbols, digests, seen), GONE).astype(np.int64)
                head, blocks = t.codes(x)
                befores = [t.back(head, blocks, v)[0][0] for v in range(len(t.vectors))]
                exits = [t.trace(x, v, q)[1] for v in range(len(t.vectors)) for q in range(4)]
                out.append(np.array([*befores, *exits], np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["chunk"], pa.array(out, pa.binary())], ["conv_id", "chunk", "map"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(tables(costs).vectors)
        conv, held, last = None, [], 0

        def flush() -> pa.RecordBatch:
            q, out = START, []
            for chunk, v, exits in reversed(held):
                out.append((chunk, v, q))
                q = exits[q]
            return pa.RecordBatch.from_pydict(dict(zip(("chunk", "last", "first"), map(pa.array, zip(*out, strict=True)), strict=True)))

        for b in batches:
            for c, chunk, m in zip(*(b[x].to_pylist() for x in ("conv_id", "chunk", "map")), strict=True):
                if held and c != conv:
                    yield flush()
                    held, last = [], 0
                conv = c
                held.append((chunk, last, m[size + 4 * last : size + 4 * last + 4]))  # a few bytes for each chunk
                last = m[last]
        if held:
            yield flush()

    rows = chunks.select("conv_id", "chunk", "symbols", "digests", "seen").mapInArrow(maps, "conv_id long, chunk long, map binary")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(joined, "chunk long, last long, first long")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_PART = "conv_id long, chunk long, audit string, repaired binary, n_repaired long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_letter long, last_letter long, low long, high long, turns long, state long"


def _repaired(chunks: DataFrame, costs: Costs) -> DataFrame:
    """Per chunk (with seen, last and first): audit, repaired turns (role:text, by newlines) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, done, size = tables(costs), [], 0
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b[c][k] for c in b.schema.names}
                copies = np.asarray(row["copies"].values)
                symbols = _settled(row["symbols"].as_py(), row["digests"].as_py(), row["seen"].as_py())
                q, last = row["first"].as_py() or START, row["last"].as_py() or 0
                edits, state = t.trace(np.minimum(symbols, GONE).astype(np.int64), last, q)
                audit, lines, cost, at = [], [], 0, 0
                roles, texts, again = row["roles"].values, row["texts"].values, (copies - 1).tolist()
                for edit in "".join(edits):
                    if edit in "IR":
                        q = NEXT[q]
                        lines.append(f"{ROLES[q]}:{texts[at].as_py() if edit == 'R' else ''}")
                    elif edit == "K":
                        q = KEPT[q, int(symbols[at]) % 4]
                        lines.append(f"{roles[at].as_py()}:{texts[at].as_py()}")
                    audit.append(edit)
                    if edit == "I":
                        cost += costs.insert
                        continue
                    cost += costs.delete * again[at] + (costs.delete if edit == "D" else (costs.rerole if edit == "R" else 0) + (costs.truncated if symbols[at] >= 4 else 0))
                    audit.append("D" * again[at])  # further copies of a row go, whatever becomes of it
                    at += 1
                letters, turns = row["letters"].as_py(), np.unique(np.asarray(row["turns"].values.drop_null()))
                blank = int(copies[symbols == GONE].sum())
                duplicate = int(copies[symbols == AGAIN].sum() + (copies[symbols < GONE] - 1).sum())
                illegal = sum(again) + sum((x, y) not in LEGAL for x, y in zip(letters, letters[1:], strict=False))
                done.append({
                    "conv_id": row["conv_id"].as_py(), "chunk": row["chunk"].as_py(), "audit": "".join(audit), "repaired": "\n".join(lines).encode(), "n_repaired": len(lines),
                    "blank": blank, "duplicate": duplicate, "truncated": int(((symbols >= 4) & (symbols < GONE)).sum()), "illegal": illegal, "cost": cost,
                    "first_letter": letters[0], "last_letter": letters[-1], "low": int(turns[0]) if len(turns) else None, "high": int(turns[-1]) if len(turns) else None, "turns": len(turns), "state": state,
                })
                size += len(done[-1]["repaired"])
                if size >= CHUNK_CHARS:
                    yield pa.RecordBatch.from_pylist(done, _arrow(_PART))
                    done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, _arrow(_PART))

    return chunks.mapInArrow(run, _PART)


def _joined(parts: DataFrame, costs: Costs) -> DataFrame:
    """Per conversation: counts, audit and digest of its parts, in order, one part at a time."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(costs)
        conv, sums, digest, lines, audit, before, low, high, turns = None, None, None, 0, [], None, None, None, 0

        def row() -> dict:
            closing, q, text = t.closing(before["state"]), before["state"], []
            for _ in closing:
                q = NEXT[q]
                text.append(f"{ROLES[q]}:")
            digest.update(("\n" if lines and text else "").encode() + "\n".join(text).encode())
            gaps = high - low + 1 - turns if low is not None else 0
            return {"conv_id": conv, "gaps": gaps, **sums, "cost": sums["cost"] + costs.insert * len(closing), "audit": "".join(audit) + closing, "repaired_sha256": digest.hexdigest(), "n_repaired": lines + len(text)}

        for b in batches:
            done = []
            for r in b.to_pylist():
                if sums is not None and r["conv_id"] != conv:
                    done.append(row())
                    sums = None
                if sums is None:
                    conv, sums, digest, lines, audit, before, low, high, turns = r["conv_id"], dict.fromkeys(_COUNTS, 0), hashlib.sha256(), 0, [], None, None, None, 0
                for c in _COUNTS:
                    sums[c] += r[c]
                if before is not None:
                    sums["illegal"] += (before["last_letter"], r["first_letter"]) not in LEGAL
                if r["low"] is not None:
                    turns += r["turns"] - (high == r["low"])
                    low, high = r["low"] if low is None else low, r["high"]
                if r["n_repaired"]:
                    digest.update((b"\n" if lines else b"") + r["repaired"])
                lines += r["n_repaired"]
                audit.append(r["audit"])
                before = {"last_letter": r["last_letter"], "state": r["state"]}
            if done:
                yield pa.RecordBatch.from_pylist(done, _arrow(schema))
        if sums is not None:
            yield pa.RecordBatch.from_pylist([row()], _arrow(schema))

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema)


def repaired_parts(turns: DataFrame, costs: Costs = Costs(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:  # noqa: B008
    """conv_id, chunk, audit, repaired (UTF-8 of role:text lines), n_repaired and counts of turns (conv_id, turn, role, text), a row for each chunk; chunks of a conversation are in order."""
    blank = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    keys = ["conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64))]  # ranges of these are ranges of the whole order
    chunks = stage(_chunked(rows.repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "role", "text"), chunk_rows), "turns")
    several = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("several"))
    parts = chunks.join(several, F.col("conv_id").eqNullSafe(F.col("several")), "left_semi").select("conv_id", "chunk", "symbols", "digests")
    parts = stage(parts, "parts")
    seen = stage(_seen_earlier(parts), "seen")
    plans = stage(_plans(parts.join(seen, "chunk", "left"), costs), "plans")
    return _repaired(chunks.join(seen, "chunk", "left").join(plans, "chunk", "left"), costs)


def repair(turns: DataFrame, costs: Costs = Costs(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:  # noqa: B008
    """Per conversation of turns (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired."""
    return _joined(repaired_parts(turns, costs, chunk_rows), costs)
