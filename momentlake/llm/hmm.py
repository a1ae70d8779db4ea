"""Language-model scoring with a hidden Markov model.

Tokens are lower-cased words and one end a document. The most frequent `top` words of the training documents
and the end emit as themselves; every other word emits as one of `SHAPES` classes by its last three bytes,
times its smoothed share of that class, in which one place is kept for unknown words. Latent states learn by
Baum-Welch over all training documents: each task runs the scaled forward-backward recursion on its chunks,
and the expected counts are summed over partitions. For this, documents are cut into sequences of `CUT`
tokens, the later ones starting from the states' overall shares. Scores are exact: the scaled forward
recursion runs over each whole document.

Word counts over the corpus are gathered by exchange between chunks of documents and buckets of word
fingerprints (64 bits). The driver holds the model alone, whose size `top`, SHAPES and the states fix.

Defined cases: a null or empty text is the end token alone; repeated rows count as often as they occur;
without training documents all words are unknown and the score equals that of an untrained model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.llm._exchange import answered, cuts, expand, squeeze, with_answers
from momentlake.llm._shared import bucketed, stage, text_bytes, text_slices
from momentlake.llm._words import U, buffers, lowered, prefix_sums, span_hash, word_spans

SHAPES, CUT = 192, 256
END = np.uint64(0x0E0D0E0D0E0D0E0D)


def tokenized(docs: DataFrame, held_out: Column, chunk_bytes: int) -> DataFrame:
    """Chunks of documents: ids, lengths, tokens as places in the chunk's sorted vocabulary, its training counts and shapes."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in text_slices(batches, "text", chunk_bytes):
            data, offsets = buffers(b["text"])
            starts, ends, row = word_spans(data, offsets)
            p = prefix_sums(lowered(data))
            h = span_hash(p, starts, ends)
            shape = (span_hash(p, np.maximum(starts, ends - 3), ends) >> U(32)).astype(np.int64) % SHAPES
            sizes = np.bincount(row, minlength=b.num_rows) + 1
            last = np.cumsum(sizes) - 1
            token, kinds = np.full(sizes.sum(), END), np.zeros(sizes.sum(), np.uint8)
            word = np.ones(len(token), bool)
            word[last] = False
            token[word], kinds[word] = h, shape
            vocabulary, first, index = np.unique(token, return_index=True, return_inverse=True)
            train = np.repeat(~b["held_out"].to_numpy(zero_copy_only=False), sizes)
            tf = np.bincount(index[train], minlength=len(vocabulary)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "chunk_id": pa.array([base + n]), "doc_ids": pa.array([b["doc_id"].to_pylist()], pa.list_(pa.int64())), "held_out": pa.array([b["held_out"].to_pylist()], pa.list_(pa.bool_())),
                "sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), "tokens": pa.array([squeeze(index.astype(np.uint32))]), "vocabulary": pa.array([vocabulary.tobytes()]),
                "tf": pa.array([squeeze(tf)]), "shapes": pa.array([squeeze(kinds[first])]),
            })
            n += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    return rows.mapInArrow(chunks, "chunk_id long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, tokens binary, vocabulary binary, tf binary, shapes binary")


def count_words(chunks: DataFrame, top: int, bucket_words: int = 1_500_000) -> DataFrame:
    """Per bucket and chunk the corpus counts of the chunk's words in it (answer); rows without a chunk sum a bucket up."""
    words = chunks.agg(F.sum(F.octet_length("vocabulary"))).first()[0] or 0
    n = max(1, -(-words // (8 * bucket_words)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, vocabulary, tf, shapes in zip(b["chunk_id"].to_pylist(), b["vocabulary"], b["tf"], b["shapes"], strict=True):
                h, tf, shapes = np.frombuffer(vocabulary.as_py(), U), expand(tf.as_py(), np.int64), expand(shapes.as_py(), np.uint8)
                at = np.append(np.searchsorted(h, cuts(n)), len(h))
                own = [k for k in range(n) if at[k] < at[k + 1]]
                part = [slice(at[k], at[k + 1]) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([chunk] * len(own), pa.int64()), *(pa.array([f(x[s]) for s in part], pa.binary()) for f, x in ((np.ndarray.tobytes, h), (squeeze, tf), (np.ndarray.tobytes, shapes)))], ["bucket", "chunk_id", "words", "tf", "shapes"])

    fields = [("bucket", pa.int64()), ("chunk_id", pa.int64()), ("answer", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]
    fields += [(c, pa.list_(pa.int64())) for c in ("shape_n", "shape_v", "top_words", "top_counts", "top_shapes")]

    def answer(t: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), U) for x in t["words"]]
        h, tf = np.concatenate(own), np.concatenate([expand(x.as_py(), np.int64) for x in t["tf"]])
        shapes = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["shapes"]])
        words, first, index = np.unique(h, return_index=True, return_inverse=True)
        count, shape = np.bincount(index, tf, len(words)).astype(np.int64), shapes[first]
        replies = np.split(count[index], np.cumsum([len(x) for x in own])[:-1])
        seen = count > 0
        best = np.lexsort((words, -count))[:top]
        best = best[count[best] > 0]
        bucket = t["bucket"][0].as_py()
        rows = [{"bucket": bucket, "chunk_id": c, "answer": squeeze(r)} for c, r in zip(t["chunk_id"].to_pylist(), replies, strict=True)]
        word = words != END  # the end has no shape
        sums = {"n": int(count.sum()), "v": int(seen.sum()), "shape_n": np.bincount(shape[word], count[word], SHAPES).astype(np.int64), "shape_v": np.bincount(shape[word & seen], minlength=SHAPES)}
        tops = {"top_words": words[best].view(np.int64), "top_counts": count[best], "top_shapes": shape[best].astype(np.int64)}
        return pa.Table.from_pylist([*rows, {"bucket": bucket} | sums | tops], pa.schema(fields))

    asked = chunks.mapInArrow(ask, "bucket long, chunk_id long, words binary, tf binary, shapes binary")
    return answered(asked, answer, "bucket long, chunk_id long, answer binary, n long, v long, shape_n array<long>, shape_v array<long>, top_words array<long>, top_counts array<long>, top_shapes array<long>", "counts")


@dataclass
class Vocabulary:
    """words: fingerprints of the words (and the end) that emit as themselves, sorted; shape_n, shape_v: counts of the rest by shape."""

    n: int
    v: int
    words: np.ndarray
    counts: np.ndarray
    shape_n: np.ndarray
    shape_v: np.ndarray

    def classes(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, words).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == words, at, len(self.words) + shapes.astype(np.int64)).astype(np.uint32)


def vocabulary(counts: DataFrame, top: int) -> Vocabulary:
    sums = counts.filter("chunk_id is null")
    total = sums.agg(F.sum("n"), F.sum("v"), *(F.sum(F.get(c, F.lit(k))) for c in ("shape_n", "shape_v") for k in range(SHAPES))).first()
    total = [x or 0 for x in total]
    each = F.explode(F.arrays_zip("top_words", "top_counts", "top_shapes")).alias("w")
    best = sums.select(each).select("w.*").orderBy(F.desc("top_counts"), "top_words").limit(top).toArrow()
    words, n, shape = (best[c].to_numpy() for c in ("top_words", "top_counts", "top_shapes"))
    words, word = words.view(U), words.view(U) != END
    shape_n, shape_v = np.array(total[2 : 2 + SHAPES], np.int64), np.array(total[2 + SHAPES :], np.int64)
    np.subtract.at(shape_n, shape[word], n[word])
    np.subtract.at(shape_v, shape[word], 1)
    if word.all():
        words, n = np.append(words, END), np.append(n, 0)
    order = np.argsort(words)
    return Vocabulary(total[0], total[1], words[order], n[order], shape_n, shape_v)


def encode(chunks: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """Chunks with the emission class of each token, and per document the base score, known tokens and log shares of shapes."""
    held = chunks.sparkSession.sparkContext.broadcast(v)  # top words and SHAPES sums

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in batches:
            for r in b.to_pylist():
                words, shapes, index = np.frombuffer(r["vocabulary"], U), expand(r["shapes"], np.uint8), expand(r["tokens"], np.uint32)
                c = np.concatenate([expand(x["answer"], np.int64) for x in r["counts"]])
                cls = v.classes(words, shapes)
                shared = cls >= len(v.words)
                base = np.log10((c + 0.1) / (v.n + 0.1 * (v.v + 1)))
                share = np.where(shared, np.log10((np.where(shared, c, 0) + 0.1) / (v.shape_n[shapes] + 0.1 * (v.shape_v[shapes] + 1))), 0.0)
                at = np.cumsum([0, *r["sizes"][:-1]])
                sums = [np.add.reduceat(x[index], at) for x in (base, share, (c > 0).astype(np.int64))]
                yield pa.RecordBatch.from_pydict({"doc_ids": pa.array([r["doc_ids"]], pa.list_(pa.int64())), "held_out": [r["held_out"]], "sizes": pa.array([r["sizes"]], pa.list_(pa.int32())), "classes": [squeeze(cls[index])], "base": [sums[0]], "share": [sums[1]], "known": [sums[2]]})

    joined = with_answers(chunks.drop("tf"), counts.filter("chunk_id is not null"), "counts")
    return joined.mapInArrow(encoded, "doc_ids array<long>, held_out array<boolean>, sizes array<int>, classes binary, base array<double>, share array<double>, known array<long>")


@dataclass
class Model:
    """start and share: of states at a document's start and overall; move: state to state; emit: class by state."""

    start: np.ndarray
    share: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _lanes(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling size, starts in it, and how many sequences reach each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, starts[order], len(sizes) - np.cumsum(np.bincount(sizes))[:-1]


def log10_likelihood(m: Model, cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scaled forward recursion over all sequences side by side."""
    order, at, active = _lanes(starts, sizes)
    out = np.zeros(len(sizes))
    a = m.start * m.emit[cls[at]]
    for t, n in enumerate(active.tolist()):
        if t:
            a = (a[:n] @ m.move) * m.emit[cls[at[:n] + t]]
        c = a.sum(1)
        a /= c[:, None]
        out[:n] += np.log10(c)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected_counts(m: Model, cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: expected starts, moves and emissions (class by state). opens: the sequence starts a document."""
    order, at, active = _lanes(starts, sizes)
    opens, steps = opens[order], active.tolist()
    a = np.where(opens[:, None], m.start, m.share) * m.emit[cls[at]]
    alphas, scales, tokens = [], [], []
    for t, n in enumerate(steps):
        tokens.append(cls[at[:n] + t])
        if t:
            a = (a[:n] @ m.move) * m.emit[tokens[-1]]
        c = a.sum(1, keepdims=True)
        a = a / c
        alphas.append(a)
        scales.append(c)
    b, moves = np.ones_like(alphas[-1]), np.zeros_like(m.move)
    for t in range(len(steps) - 2, -1, -1):
        n = steps[t + 1]
        w = m.emit[tokens[t + 1]] * b / scales[t + 1]
        alphas[t + 1] *= b
        moves += alphas[t][:n].T @ w
        b = np.ones_like(alphas[t])
        b[:n] = w @ m.move.T
    alphas[0] *= b
    flat, gamma = np.concatenate(tokens), np.concatenate(alphas)
    emitted = np.stack([np.bincount(flat, gamma[:, s], len(m.emit)) for s in range(gamma.shape[1])], 1)
    return alphas[0][opens].sum(0), m.move * moves, emitted


def sequences(sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and opens of the sequences of at most CUT tokens of the documents that are kept."""
    first = np.cumsum(sizes) - sizes
    first, sizes = first[keep], sizes[keep]
    parts = -(-sizes // CUT)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(first, parts) + k * CUT, np.minimum(CUT, np.repeat(sizes, parts) - k * CUT), k == 0


def train(encoded: DataFrame, v: Vocabulary, states: int, rounds: int) -> Model:
    rng, prior = np.random.default_rng(5), np.concatenate([v.counts, v.shape_n]) + 0.1
    prior = prior / prior.sum()
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
    m = Model(np.full(states, 1 / states), np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(0))
    columns = [f"s{k}" for k in range(states)]
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], m: Model = m) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + states + len(m.emit), states))
            for b in batches:
                for sizes, held, cls in zip(b["sizes"], b["held_out"], b["classes"], strict=True):
                    s = sequences(np.asarray(sizes.values), ~np.asarray(held.values.to_numpy(zero_copy_only=False)))
                    if len(s[0]):
                        total += np.vstack(expected_counts(m, expand(cls.as_py(), np.uint32), *s))
            seen = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[seen, k]) for k in range(states))], ["row", *columns])

        counts = encoded.select("sizes", "held_out", "classes").mapInArrow(expect, "row long, " + ", ".join(f"{c} double" for c in columns))
        got = counts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        total = np.zeros((1 + states + len(m.emit), states))
        total[got["row"].to_numpy()] = np.stack([got[c].to_numpy() for c in columns], 1)
        start, move, emit = total[0] + 0.1, total[1 : 1 + states] + 0.1, total[1 + states :]
        share = emit.sum(0) + 0.1
        emit = emit + prior[:, None]  # one token more a state, spread as all tokens are
        m = Model(start / start.sum(), share / share.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return m


def score_documents(docs: DataFrame, held_out: Column, states: int = 8, rounds: int = 6, top: int = 4000, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text); held_out: documents not learned from."""
    spark = docs.sparkSession
    chunks = bucketed(tokenized(docs, held_out, chunk_bytes), "tokens", "chunk_id", text_bytes(docs))
    counts = count_words(chunks, top)
    v = vocabulary(counts, top)
    encoded = stage(encode(chunks, counts, v), "encoded")
    held = spark.sparkContext.broadcast((train(encoded, v, states, rounds), v.n))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = held.value
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                score = log10_likelihood(m, expand(r["classes"], np.uint32), np.cumsum(sizes) - sizes, sizes) + np.array(r["share"])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["held_out"], pa.bool_()), pa.array(sizes), pa.array(r["known"], pa.int64()), pa.array(np.full(len(sizes), n)), pa.array(r["base"], pa.float64()), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(scored, schema)
