import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from momentlake.llm import line_dedup, near_dedup, suffix_dedup
from momentlake.llm.components import components
from momentlake.llm._words import buffers, prefix_sums, span_hash, word_spans, words
from tests.llm import brute


def test_words_do_not_cross_rows():
    texts = ["ab", "cd ", None, "", " Ab\tcd\x0b", "é Ab"]
    h, offsets = words(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(brute.split(t)) for t in texts]
    flat = [w for t in texts for w in brute.split(t)]
    assert [[a == b for b in flat] for a in flat] == (h[:, None] == h[None, :]).tolist()
    data, offs = buffers(pa.array(["xabab", "ab"]))
    assert len(set(span_hash(prefix_sums(data), np.array([1, 3, 5]), np.array([3, 5, 7])).tolist())) == 1
    assert word_spans(data, offs)[2].tolist() == [0, 1]


def _substring_oracle(rows, window):
    """By (doc_id, start): a window that also starts earlier marks its bytes."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, suffix_order(r[1])))
    seen, out = {}, {}
    for doc in order:
        b = (doc[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if b[k : k + window] in seen:
                gone[k : k + window] = True
            else:
                seen[b[k : k + window]] = True
        out[doc] = (len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def suffix_order(text):
    import hashlib

    return int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "little", signed=True)


def test_suffix_dedup(docs, corpus):
    rows = [*corpus, (0, corpus[7][1]), (500, corpus[2][1][50:700]), (501, "ab" * 300 + corpus[2][1][:99])]
    expected = _substring_oracle(rows, 100)
    got = suffix_dedup.remove_repeats(docs(rows), chunk_bytes=3000, bucket_rows=500).collect()
    assert len(got) == len(rows)
    want = sorted((d[0] is not None, d[0] or 0, *expected[d]) for d in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.removed), bytes(r.kept)) for r in got) == want
    assert suffix_dedup.remove_repeats(docs(rows).limit(0)).count() == 0


def test_a_passage_in_many_contexts_is_split(docs):
    """All suffixes that reach into one passage share a bucket; each in its own context, they are dealt to parts of it."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(200)
    rows = [(i, noise(300) + passage + noise(300)) for i in range(120)] + [(500 + i, noise(150)) for i in range(20)]
    df, window, bucket_rows = docs(rows), 100, 256
    chunks = suffix_dedup.pack(df, 4000)
    known = chunks.join(suffix_dedup.copies(chunks.drop("data"), window), "chunk_id", "left")
    known = suffix_dedup.with_answers(known, suffix_dedup.rank_samples(known, window, 8), "ranks")
    asked = suffix_dedup._asked(known, window, 8, 40).cache()
    large = suffix_dedup.large_buckets(asked, bucket_rows).cache()
    before = asked.groupBy("bucket").agg(F.sum("n").alias("n"))
    parts = suffix_dedup.split_large(asked.join(large, "bucket"), window, 40)
    after = parts.groupBy("bucket").agg(F.sum("n").alias("n"))
    assert before.agg(F.max("n")).first()[0] > 8 * bucket_rows and large.count() > 0
    assert after.agg(F.max("n")).first()[0] < suffix_dedup.LARGE * bucket_rows
    assert parts.agg(F.sum("n")).first()[0] == asked.join(large, "bucket").agg(F.sum("n")).first()[0]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, window, chunk_bytes=4000, bucket_rows=bucket_rows).collect()}
    assert got == {d: kept for (d, _), (_, _, kept) in _substring_oracle(rows, window).items()}


def test_suffixes_are_in_true_order():
    """Sorted by bytes, whatever repeats: binary noise, runs of one byte, short patterns, zero bytes at the end."""
    rng = np.random.default_rng(1)
    for window in (57, 64, 100):
        base = [rng.integers(0, 2, 300, dtype=np.uint8).tobytes() for _ in range(3)]
        strings = [base[rng.integers(3)][i : i + int(rng.integers(window, 200))] for i in rng.integers(0, 100, 40).tolist()]
        strings += [bytes(int(n)) for n in rng.integers(window, 255, 5)] + [(b"abc" * 90)[int(k) :][:200] for k in rng.integers(0, 9, 5)]
        order, same = suffix_dedup.sorted_suffixes(strings, window)
        suffixes = [x[k:] for x in strings for k in range(len(x) - window + 1)]
        got = [suffixes[k] for k in order.tolist()]
        assert got == sorted(suffixes)
        assert same.tolist() == [False, *(a[:window] == b[:window] for a, b in zip(got, got[1:], strict=False))]


def test_hot_windows_are_asked_once_a_chunk(docs, monkeypatch):
    rows = [(i, "ha " * (400 + i) + f"end {i % 3} " * 20) for i in range(6)] + [(2, "ha " * 402 + "end 2 " * 20), (9, "-" * 3000)]
    sizes, answered = [], suffix_dedup.answered

    def spied(questions, answer, schema, name):
        if name == "ranks":
            asked = questions.select(F.sum(F.octet_length("keys") / 5)).first()[0]
        else:
            asked = sum(int(suffix_dedup.expand(r.places, np.int64)[3::4].sum()) for r in questions.select("places").collect())
        sizes.append((asked, questions.select("chunk_id").distinct().count()))
        return answered(questions, answer, schema, name)

    monkeypatch.setattr(suffix_dedup, "answered", spied)
    got = suffix_dedup.remove_repeats(docs(rows), chunk_bytes=4000, bucket_rows=500).collect()
    want = _substring_oracle(rows, 100)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, sum(x.end - x.start for x in r.removed), bytes(r.kept)) == want[(r.doc_id, dict(rows)[r.doc_id])]
    assert len(sizes) == 2 and all(n <= 400 * chunks for n, chunks in sizes)  # "ha " has three windows, whatever its length


def test_near_dedup(docs, corpus):
    repeated = [(900, corpus[1][1]), (900, corpus[9][1]), (901, "own words " + corpus[3][1][:40]), (901, None), (902, corpus[1][1]), (902, ""), (903, ""), (903, None)]
    for size, block, rows in ((2, 2048, corpus), (5, 3, corpus), (2, 3, [*corpus, *repeated])):
        want = brute.near_components(rows, size)
        got = near_dedup.near_duplicates(docs(rows), size=size, block=block, bucket=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id]), r
        n = sorted((len(w) - size + 1 if len(w) >= size else min(1, len(w))) for w in (brute.split(t) for _, t in rows))
        assert all(r.n_shingles <= max(n) for r in got)
    sizes = {r.doc_id: r.n_shingles for r in near_dedup.near_duplicates(docs(corpus), size=2).collect()}
    for i, t in corpus:
        w = brute.split(t)
        assert sizes[i] == (len({tuple(w[k : k + 2]) for k in range(len(w) - 1)}) if len(w) > 1 else len(w)) or i is None
    assert near_dedup.near_duplicates(docs([])).count() == 0


def test_near_dedup_of_a_family_of_many_unlinked_nodes(docs):
    """Texts around a common core: many share band keys and few are links; some form chains."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    core = rng.sample(words, 70)
    rows = [(i, " ".join([*core, *rng.sample(words, 30)])) for i in range(60)]
    chain = rng.sample(words, 100)
    for i in range(40):
        rows.append((1000 - i, " ".join(chain)))
        chain[rng.randrange(100)] = f"new{i}"
    want = brute.near_components(rows, 2)
    assert len(set(want.values())) > 5
    got = near_dedup.near_duplicates(docs(rows), size=2, block=8, bucket=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    samples = near_dedup.minhash(np.concatenate([a, b]), np.array([0, 1000]), near_dedup.LARGE[0])
    s = near_dedup.odd_sketches(samples, near_dedup.LARGE[1])
    ones = int(np.bitwise_count(s[0] ^ s[1]).sum())
    assert abs(ones - near_dedup.most_ones(900 / 1100, near_dedup.LARGE, margin=False)) < 150
    assert ones <= near_dedup.most_ones(0.8, near_dedup.LARGE)


def test_line_dedup(docs):
    rows = [(1, "a\nb\nc\nd\nx"), (2, "q\na\nb\nc\nd"), (3, "a\nb\nz"), (4, "b\nc\nd\nb\nc\nd"), (5, None), (6, ""), (7, "\n\n\n\n"), (8, "\n\n\n\n"), (2, "q\na\nb\nc\nd"), (2, "c\nb\na\nb\nc"), (None, "a\nb\nc")]
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(docs(rows)).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_removed))
        assert r.source == "x" and r.score == 1
    assert got[1] == [("d\nx", 5, 3)]
    assert got[None] == [("a\nb\nc", 3, 0)]  # null sorts first and keeps its window
    assert got[3] == [("a\nb\nz", 3, 0)]
    assert got[5] == [(None, 0, 0)] and got[6] == [("", 1, 0)]
    assert got[7] == got[8] == [("\n\n\n\n", 5, 0)]
    assert got[4] == [("", 6, 6)]
    assert len(got[2]) == 3
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_line_dedup_keeps_columns_of_any_name_and_long_texts(docs):
    long = "\n".join(f"line {i % 5000}" for i in range(20_000))
    rows = docs([(1, long), (2, "a\nb\nc"), (3, "x\na\nb\nc")])
    names = ("text_hash", "lines", "id", "h", "places", "left", "n_lines", "pos")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(rows.withColumns({c: F.lit("mine") for c in names})).collect()}
    assert all(r[c] == "mine" for r in got.values() for c in names if c != "n_lines")
    assert (got[1].n_lines, got[1].n_removed, got[3].text) == (20_000, 15_000, "x")


def test_components_of_hubs_chains_and_random_graphs(spark):
    rng = random.Random(8)
    edges = [(1000 + i, 7) for i in range(500)] + [(i, i + 1) for i in range(3000, 3060)] + [(5, 5), (1001, 2), (2, 1001)]
    edges += [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)]
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == least and len(got) == len(least)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
