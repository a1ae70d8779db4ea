import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from momentlake.llm import bpe, queries

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def same(text):
    got, want = bpe.codec(PATH).encode([text])[0], LIBRARY.encode(text, add_special_tokens=False).ids
    assert got.tolist() == want
    assert bpe.codec(PATH).decode(got) == LIBRARY.decode(want, skip_special_tokens=False) == text


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "'", "'s", "'ll", "'re", "'LL", "s", "ve", "d", "don", "1", "²", "!", "é", "中", "\u0558", "\U0003134f", "<|endoftext|>", "<|", "’s"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join) | st.text(max_size=40))
@example("we'll 's 's's '' 'sabc !'s x'\n 'd")
@example(" \n")
def test_ids_and_text_are_those_of_the_library(text):
    same(text)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "ab", "x", "é", "中", "'s", "<|endoftext|>"])
def test_long_runs(unit):
    for tail in ("", "x", " x", "\n"):
        same(unit * 70_000 + tail)


def test_five_million_blanks():
    same(" " * 5_000_000 + "x")


def test_long_words_of_random_letters():
    rng = random.Random(3)
    for n in (63, 64, 65, 66, 300, 60_000):
        same("".join(rng.choice("abcdefghij") for _ in range(n)))


def test_texts_longer_than_a_piece_of_work(monkeypatch):
    monkeypatch.setattr(bpe, "_CHARS", 50)
    rng = random.Random(5)
    for _ in range(50):
        same("".join(rng.choice(["ab", " ", "\n", "'s", "1", ".", "<|endoftext|>", "é"]) for _ in range(400)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert bpe.codec(PATH).decode(np.array(ids, np.int32)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_other_files_are_refused(tmp_path):
    spec = json.loads(open(PATH).read())
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Codec(str(tmp_path / "t.json"))


def test_documents(spark, docs, corpus):
    rows = [*corpus, (500, " " * 300_000), (501, "a<|endoftext|>b"), (502, "x" * 200_000)]
    df = docs(rows).withColumnRenamed("score", "ids")
    out = bpe.decode(bpe.encode(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    for r in out:
        assert r.ids == LIBRARY.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.source == "x"
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [-1, 15496, 99999]), (3, [220, None])], "k int, ids array<int>")
    assert sorted((r.k, r.decoded) for r in bpe.decode(odd).collect()) == [(1, ""), (2, "Hello"), (3, " ")]


def test_query(spark):
    got = {r.doc_id: r for r in queries.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        own = got[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
