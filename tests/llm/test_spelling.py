import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from momentlake.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, every=199, least=6):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    words = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words)


def result(df, **more):
    return sorted(tuple(r) for r in spelling.variants(df, **more).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_scan_is_the_edit_distance():
    rng = random.Random(1)
    for letters, shared in (("ab", 0), ("abc", 3), ("abé", 1)):
        words = sorted({"b" * shared + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(120)})
        other = sorted({"".join(rng.choice(letters) for _ in range(4)) for _ in range(40)})
        x, sizes = spelling.letters_of([w.encode("latin-1") for w in words + other])
        n, m = len(words), len(other)
        q, w = spelling.scan(x, sizes, np.repeat([0, n], [n, m]), np.repeat([n, n + m], [n, m]), np.repeat([shared, 0], [n, m]))
        both = words + other
        want = {(a, b) for part in (range(n), range(n, n + m)) for a in part for b in part if one_edit(both[a], both[b])}
        assert set(zip(q.tolist(), w.tolist(), strict=True)) == want and len(q) == len(want)


@pytest.mark.parametrize("list_bytes", [60, 400, 1 << 18])
def test_variants(spark, docs, list_bytes):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeÀÿé×") for _ in range(rng.randrange(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    bag = []
    for s in stems:
        bag += [s] * rng.choice([5, 30, 200])
        for _ in range(12):
            k = rng.randrange(len(s) + 1)
            v = rng.choice([s[:k] + rng.choice("abcxé") + s[k:], s[:k] + s[k + 1 :], s[:k] + rng.choice("abcxé") + s[k + 1 :]])
            bag += [v] * rng.choice([1, 5, 6, 40])
    rng.shuffle(bag)
    rows = [(i % 17, rng.choice([" ", "-", "1", "\n", "中", "'"]).join(w.upper() if rng.random() < 0.1 else w for w in bag[i::40])) for i in range(40)]
    rows += [(None, "aaaaaaa " * 9), (None, None), (3, ""), (4, "short a " * 50), rows[0]]
    assert result(docs(rows), change=spelling.drop_one_of(3), list_bytes=list_bytes) == plain(rows, 3)


def test_a_third_of_all_words_share_beginning_and_end(spark, docs):
    rng = random.Random(6)
    hot = ["prefix" + "".join(rng.choice("abcd") for _ in range(4)) + "suffix" for _ in range(300)]
    other = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    rows = [(i, " ".join(hot + other)) for i in range(6)]
    listed = spelling._listed(spelling.vocabulary(docs(rows)), 2000)
    sizes = listed.groupBy("key", "a", "b", "size").count().selectExpr("count * size as bytes", "b - a as places").collect()
    assert all(r.bytes <= 2000 or r.places == 1 for r in sizes)
    assert result(docs(rows), list_bytes=2000) == plain(rows, 0)


def test_long_words_and_empty_tables(spark, docs):
    w = "x" * 3000
    rows = [(i, f"{w}a {w}b {w} {w[:40]} " * (1 + 5 * (i == 0))) for i in range(5)] + [(9, ("x" * 41 + " ") * 60)]
    assert result(docs(rows)) == plain(rows, 0)
    assert spelling.variants(docs([(1, None)])).count() == 0
    assert spelling.variants(docs([(1, "a")]).limit(0)).count() == 0


def test_forms_lead_to_the_last_word(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("v", "w3")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string"), 12).collect())
    assert set(got.values()) == {"w11"} and len(got) == 12


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    df = queries.op11_spelling(spark, sf)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.SQL['op11_spelling']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want))
    assert want
