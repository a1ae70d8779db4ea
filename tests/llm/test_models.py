import math
import random
import re
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from momentlake.llm import ann, decontaminate, hmm, packing, toxicity
from momentlake.llm._words import U, prefix_sums, span_hash
from tests.llm import brute


def test_packing(docs, corpus):
    rows = [*corpus, (600, "one<|endoftext|> two  <|endoftext|>\n three <|endoftext"), (601, "<|endoftext|>")]
    pieces = packing.tokenize(docs(rows), capacity=64, with_ids=True).collect()
    by = {}
    for r in sorted(pieces, key=lambda r: r.piece):
        by.setdefault(r.doc_id, []).append(r)
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for i, text in dict(rows).items():
        if i is None or [r[0] for r in rows].count(i) > 1:
            continue
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert sum((p.ids for p in by[i]), []) == ids
        assert [p.start for p in by[i]] == np.cumsum([0, *(p.length for p in by[i][:-1])]).tolist()
        assert all(p.length == 64 for p in by[i][1:])
        assert by[i][0].ids_crc32 == crc32(np.array(by[i][0].ids, "<u4").tobytes())
    out = packing.pack(packing.tokenize(docs(rows), capacity=64), capacity=64, group_rows=20).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in out) == sorted((r.doc_id or -1, r.piece, r.length) for r in pieces)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 64
    lengths = np.array([r.length for r in out])
    assert packing.lower_bound(lengths, 64) <= len(bins) <= packing.lower_bound(lengths, 64) + 3
    assert packing.pack(packing.tokenize(docs([]))).count() == 0
    blank = packing.tokenize(docs([(1, " " * 1_500_000), (2, "\n" * 1_100_000 + "x")]), with_ids=True).orderBy("doc_id", "piece").collect()
    for k, text in ((1, " " * 1_500_000), (2, "\n" * 1_100_000 + "x")):
        assert [i for r in blank if r.doc_id == k for i in r.ids] == [*t.encode(text, add_special_tokens=False).ids, 0]
    clash = packing.tokenize(docs(rows), capacity=64).withColumns({c: F.lit("mine") for c in ("group", "out", "_out", "offset", "GROUP_")})
    again = packing.pack(clash, capacity=64, group_rows=20).collect()
    assert len(again) == len(out) and all((r.group, r.out, r["_out"], r["GROUP_"]) == ("mine",) * 4 and r.offset < 64 for r in again)


def test_lower_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 30, rng.integers(1, 40))
        assert packing.lower_bound(lengths, 30) <= packing.best_fit_decreasing(lengths, 30)[2]
    assert packing.lower_bound(np.array([16, 16, 16]), 30) == 3


def test_packing_ends_where_gaps_stay(spark):
    def packed(lengths, group_rows):
        rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
        pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(2)
        with ThreadPoolExecutor(1) as pool:
            job = pool.submit(lambda: packing.pack(pieces, group_rows=group_rows).collect())
            for _ in range(600):  # then the jobs fail, and the thread with them
                if job.done():
                    break
                time.sleep(0.1)
            else:
                spark.sparkContext.cancelAllJobs()
            out = job.result()
        assert sorted(r.doc_id for r in out) == list(range(len(lengths)))
        bins = {}
        for r in out:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
        return len(bins)

    mix = [1028] * 180 + [520] * 180 + [516] * 180 + [504] * 360
    assert packed(mix, 200) <= 1.02 * packing.best_fit_decreasing(np.array(mix), 2048)[2] + 3
    thirds = [(834, 738, 651)[i % 3] for i in range(600)]
    alone = packing.best_fit_decreasing(np.array(thirds), 2048)[2]
    assert packed(thirds, 60) <= 1.02 * alone + 3
    assert packed([1] * 200, 20) == 1  # all groups together are less than half a sequence


def _toxic_rows(n):
    rng = random.Random(2)
    clean = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(clean, k=40), rng.random() < 0.3
        words[3] = "fool" + rng.choice("abcdef") if toxic else "food"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = _toxic_rows(600)
    y = spark.createDataFrame([*labels, (9999, 1), (3, None)], "doc_id long, toxic int")
    held = F.col("doc_id") % 4 == 2
    out = toxicity.score_toxicity(docs([*rows, (5000, None), (5001, ""), (5002, "fool! " * 20_000)]), y, held).collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.source == "x" for r in out)
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in out if r.doc_id % 4 == 2 and r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert {r.predicted for r in out if r.doc_id in (5000, 5001)} <= {0, 1}
    none = toxicity.score_toxicity(docs(rows[:3]), y.limit(0)).collect()
    assert [r.score for r in none] == [0, 0, 0]
    assert toxicity.score_toxicity(docs([]), y).count() == 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        sets.append(np.array([0] * int(a) + [1] * int(b) + [2 + rng.integers(5)]))
        y.append(float(a and b))
    m = toxicity.fit_machine(sets, np.array(y), np.arange(8), 8, epochs=30)
    s = [m.logits(np.zeros(len(f), int), np.array(f), 1)[0] for f in ([0, 1], [0], [1], [2])]
    assert s[0] > 0 > max(s[1:])


def test_scores_against_brute_force(spark, docs):
    rows, labels = _toxic_rows(300)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs(rows), y)
    for r in toxicity.score(docs([*rows[:20], (800, None), (801, "é fool! FOOLa")]), model).collect():
        assert math.isclose(r.score, brute.toxicity_score(model, r.text), rel_tol=1e-9) and r.predicted == (r.score >= 0.3)


def test_few_labels_are_enough(spark, docs):
    rows, labels = _toxic_rows(120)
    held = F.col("doc_id") % 4 == 2
    out = toxicity.score_toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), held).collect()
    toxic = {i for i, t in labels if t and i % 4 == 2}
    assert len(toxic & {r.doc_id for r in out if r.predicted}) >= 0.8 * len(toxic)


def test_terms_do_not_cross_texts():
    rows, _ = toxicity.term_sets(pa.array(["abcd", "abcd efgh", None, ""]))
    assert np.bincount(rows, minlength=4).tolist() == [2, 4, 0, 0]


BENCH = [(1, "A train leaves at 10 km per hour and then reaches the town after 25 minutes of travel with Anna and Ben on board"), (2, "too short"), (3, None), (4, "what is the capital of the country where the river ends")]


def test_decontaminate(spark, docs):
    text = BENCH[0][1]
    other = text.replace("10", "45").replace("25", "60").replace("Anna", "Carl").replace("Ben", "Dora")
    rows = [(1, "So. " + text + " fine"), (2, "So. " + other), (3, text.upper()), (4, text.replace("town", "city").replace("leaves", "goes").replace("per", "an").replace("travel", "way")), (5, None), (6, ""), (7, "He asked " + BENCH[3][1]), (8, "x " * 30_000 + text), (1, "So. " + text)]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for bound in (1_000_000, 3):
        got = decontaminate.find_leaks(docs(rows), bench, bound=bound).collect()
        assert len(got) == len(rows)
        hit = {r.doc_id: sorted({x.item_id for x in r.leaks}) for r in got}
        assert hit == {1: [1], 2: [1], 3: [1], 4: [], 5: [], 6: [], 7: [4], 8: [1]}
    assert decontaminate.find_leaks(docs([]), bench).count() == 0
    assert decontaminate.find_leaks(docs(rows), bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_verbatim_copies_match(spark, docs):
    items = [
        "Find the next: 2 4 8 16 32 64 128 256 512",
        "What is the capital of France today",
        "When the sun is low\nIts light is red in the sky\nMost of the blue is gone\nWhere did it go then",
        "Ask Anna Berta Carl Dora Emil Franz Gustav who came",
    ]
    rows = [
        (1, f"so {items[0]} end"),
        (2, f"a list\n- {items[1]}?"),
        (3, f'he said "stop." {items[1]}'),
        (4, "they all asked What is the capital of Spain today"),
        (5, "> " + items[2].replace("\n", "\n> ")),
        (6, "and so " + items[2].replace("\n", " ")),
        (7, items[3]),
        (8, "so Find the next: 3 9 27 81 243 729 1 7 5 end"),
        (9, "they all asked Where is the capital of France today"),
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.leaks for r in decontaminate.find_leaks(docs(rows), bench).collect()}
    assert {k: sorted({x.item_id for x in v}) for k, v in got.items()} == {1: [0], 2: [1], 3: [1], 4: [1], 5: [2], 6: [2], 7: [3], 8: [], 9: []}
    assert len(got[5]) == len(got[6]) == len(items[2].split()) - 12
    assert all(len(set(v)) == len(v) for v in got.values())


def test_short_and_slot_heavy_items_match_as_whole_sentences(spark, docs):
    items = [(0, "What is 12 + 35 - 7?"), (1, "What is 10 + 20 - 10?"), (2, "Sum up 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (3, "Yes"), (4, "too short"), (5, "What is 12 + 35 - 7?")]
    rows = [
        (1, "It rains. What is 12 + 35 - 7? Tell me"),
        (2, "It rains. What is 81 + 44 - 9? Tell me"),
        (3, "It rains. What is 81 + 44 - 81?"),
        (4, "He knows what is 81 + 44 - 9 of it"),
        (5, "Sum up 9 8 7 6 5 4 3 2 1 0 21 22 23 24"),
        (6, "Sum up 9 9 7 6 5 4 3 2 1 0 21 22 23 24"),
        (7, "this is too short to read. Yes. Yes"),
        (8, "Well!\ntoo short\nand so on"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    for bound in (1_000_000, 2):
        got = {r.doc_id: sorted({x.item_id for x in r.leaks}) for r in decontaminate.find_leaks(docs(rows), bench, bound=bound).collect()}
        assert got == {1: [0], 2: [0], 3: [1], 4: [], 5: [2], 6: [], 7: [], 8: [4]}


def test_decontaminate_against_brute_force(spark, docs):
    rng = random.Random(12)
    words = "what is the sum of all red and blue balls in a box when you take some out".split()
    text = lambda k: " ".join(rng.choice(words) if rng.random() < 0.8 else str(rng.randrange(4)) for _ in range(k))
    items = [(i, text(rng.choice([7, 13, 15]))) for i in range(12)]
    rows = []
    for i in range(60):
        own = items[rng.randrange(12)][1]
        swap = {str(k): str(v) for k, v in zip(range(4), rng.sample(range(10, 99), 4), strict=True)}
        if i % 2:
            own = " ".join(swap.get(w, w) for w in own.split())
        if i % 3 == 0:
            own = own.replace("the", "this", 1)
        rows.append((i, f"{text(rng.randrange(20))} {own} {text(rng.randrange(20))}".strip()))
    found = {r.doc_id: {x.start for x in r.leaks} for r in decontaminate.find_leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        want = set()
        for _, item in items:
            n = min(13, len(item.split()))
            for one, slots, exact in brute.plain_windows(item, n):
                for k, (two, own, words_) in enumerate(brute.plain_windows(t, n)):
                    same = one == two and 2 * sum(x != "<n>" for x in one) >= n and decontaminate.consistent(np.array(slots, object), np.array(own, object))
                    if same or exact == words_:
                        want.add(k)
        assert found[i] == want, (i, t)


def test_slot_consistency():
    one = np.array([1, 2, 1])
    assert decontaminate.consistent(one, np.array([7, 8, 7]))
    assert not decontaminate.consistent(one, np.array([7, 8, 9])) and not decontaminate.consistent(one, np.array([7, 7, 7]))


def test_forward_is_exact_and_em_does_not_get_worse():
    rng = np.random.default_rng(3)
    m = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random(3), rng.random((3, 3)))), rng.random((5, 3)))
    m.emit /= m.emit.sum(0)
    cls, sizes = rng.integers(0, 5, 12), np.array([4, 1, 7])
    got = hmm.log10_likelihood(m, cls, np.array([0, 4, 5]), sizes)
    for k, (s, n) in enumerate(((0, 4), (4, 1), (5, 7))):
        p = m.start * m.emit[cls[s]]
        for t in range(1, n):
            p = (p @ m.move) * m.emit[cls[s + t]]
        assert math.isclose(got[k], math.log10(p.sum()), rel_tol=1e-12)
    starts, moves, emitted = hmm.expected_counts(m, cls, np.array([0, 4, 5]), sizes, np.ones(3, bool))
    assert math.isclose(starts.sum(), 3) and math.isclose(moves.sum(), 9) and np.allclose(emitted.sum(1), np.bincount(cls, minlength=5))
    better = hmm.Model(starts / 3, m.share, moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))
    assert hmm.log10_likelihood(better, cls, np.array([0, 4, 5]), sizes).sum() > got.sum()


def test_hmm_scores(docs, corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\0"] for _, t in corpus]
    out = crc32(b"0") % 10
    train = [t for (i, _), t in zip(corpus, tokens, strict=True) if (0 if i is None else i) % 3]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    got = hmm.score_documents(docs(corpus), F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 0, states=3, rounds=3, top=20, chunk_bytes=4000).collect()
    want = sorted((len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for t in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and out >= 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert hmm.score_documents(docs([]), F.lit(False)).count() == 0
    untrained = hmm.score_documents(docs([(1, "a b"), (2, None)]), F.lit(True), rounds=1).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(np.isfinite(r.score) for r in untrained)


def test_hmm_scores_against_brute_force(docs, corpus, monkeypatch):
    seen, train = {}, hmm.train
    monkeypatch.setattr(hmm, "train", lambda encoded, v, *a: seen.setdefault("model", (v, train(encoded, v, *a)))[1])
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 5000]
    got = hmm.score_documents(docs(rows), F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 0, states=3, rounds=2, top=25, chunk_bytes=3000).collect()
    v, model = seen["model"]
    held = lambda i: (i or 0) % 3 == 0
    count = Counter(w for i, t in rows if not held(i) for w in [*brute.split(t), None])
    assert (v.n, v.v) == (sum(count.values()), len(count)) and len(v.words) <= 26
    known = {None: hmm.END}
    shape = {}
    for w in {w for _, t in rows for w in brute.split(t)}:
        data = np.frombuffer(w.encode(), np.uint8)
        p, n = prefix_sums(data), len(data)
        known[w] = span_hash(p, np.array([0]), np.array([n]))[0]
        shape[w] = int(span_hash(p, np.array([max(0, n - 3)]), np.array([n]))[0] >> U(32)) % hmm.SHAPES
    own = set(v.words.tolist())
    rest = {w: c for w, c in count.items() if int(known[w]) not in own}
    want = []
    for i, t in rows:
        classes, share = [], 0.0
        for w in [*brute.split(t), None]:
            if int(known[w]) in own:
                classes.append(v.words.tolist().index(int(known[w])))
            else:
                mates = [c for x, c in rest.items() if shape[x] == shape[w]]
                classes.append(len(v.words) + shape[w])
                share += math.log10((count.get(w, 0) + 0.1) / (sum(mates) + 0.1 * (len(mates) + 1)))
        want.append((i is not None, i or 0, len(classes), round(brute.hmm_log10(model, classes) + share, 6)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in got) == sorted(want)


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8))
    x[:300] = x[0]
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (904, [1.0] * 5), (905, [float("inf")] * 8), (7, rows[7][1]), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10, leaf_rows=16, shard_rows=100, sample=400).collect()
    y = np.array([r[1] for r in rows[:800]])
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 800, 20))
    for q, found in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(800), d))[:10]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11))
        assert all(math.isclose(r.score, d[r.vec_id], abs_tol=1e-12) for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(best.tolist()))
    assert hits >= 0.9 * 10 * len(by)
    few = ann.nearest_neighbours(df.filter("vec_id < 320 and vec_id >= 317"), F.col("vec_id") == 318, k=10).collect()
    assert sorted(r.vec_id for r in few) == [317, 319]
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_ann_counts_a_repeated_id_once(spark):
    x = np.random.default_rng(6).normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest_neighbours(df, F.col("vec_id") < 3, k=10, leaf_rows=10_000).collect()
    for q in range(3):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.argsort(d)[:10].tolist()
    place, _ = ann._top(x[0], 0, np.repeat(x, 12, 0), np.repeat(np.arange(60), 12), 10)
    assert len(set((place // 12).tolist())) == 10
