import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from momentlake.llm import toxicity
from momentlake.llm._shared import stage
from tests.llm import brute

SF = "/root/testdata/sf0.001"
CLASH = ("leaks", "predicted", "score", "n_lines", "n_removed", "_toxic", "lines", "group", "sequence_id")


def test_stages_by_hand(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, function in pipeline.STAGES[:-1]:
        out = stage(function(spark, left, SF), name)
        assert out.columns == columns and out.count() <= left.count()
        assert out.join(left, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert out.count() == left.count() and out.filter("n_chars <> length(text)").count() == 0
        left = out
    packed = pipeline.STAGES[-1][1](spark, left, SF)
    assert packed.select("doc_id").distinct().count() == left.count()
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.filter("n > 2048").count() == 0


def _tables(spark, folder):
    """Documents with toxic ones, repeated lines, near copies, leaks, nulls, ties, repeated rows and columns of clashing names."""
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "sul") for b in ("na", "do", "mi", "ra", "lo", "pe")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(16)) for i in range(4)] + [(9, None)]
    block = "\n".join(line(6) for _ in range(5))
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(line(9) for _ in range(rng.randrange(3, 8)))
        toxic = i % 5 == 0
        text = text + " fool" if toxic else text
        text = f"{text}\n{block}" if i % 7 == 0 else text
        text = f"{text} {items[i % 4][1]}" if i % 11 == 0 else text
        rows.append((i, text))
        labels.append((i, int(toxic)))
    for i in range(20):
        own = rows[3 * i + 1][1].split(" ")
        own[rng.randrange(len(own))] = "zz"
        rows.append((500 - i, " ".join(own)))
    for i in range(6):  # of one line, so that line dedup leaves them
        own = line(120)
        rows += [(700 + i, own), (720 - i, own.replace(" ", " zz ", 1)), (740 + i, own if i else own + " zz yy")]
    rows += [(2, rows[2][1]), (600, None), (601, ""), (None, rows[4][1]), (602, "\n\n\n\n"), (603, line(3000)), (603, None)][:-1]
    docs = spark.createDataFrame([(i, t, "x", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in CLASH}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (2, None), (9999, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages_against_brute_force(spark, tmp_path):
    items = _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    by_id = lambda pairs: sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))

    def went_right(df):
        for r in df.collect():
            assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for c in CLASH) and r.source == "x"
            assert r.n_chars == (None if r.text is None else len(r.text))
        return rows(df)

    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(docs, labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    given = rows(docs)
    clean = stage(pipeline.drop_toxic(spark, docs, str(tmp_path)), "clean")
    want = [(i, t) for i, t in given if brute.toxicity_score(model, t) < 0.3]
    assert by_id(went_right(clean)) == by_id(want) and 120 < len(want) < len(given) - 20

    cut = stage(pipeline.drop_repeated_lines(spark, clean, str(tmp_path)), "cut")
    left = brute.lines_left(want)
    assert by_id(went_right(cut)) == by_id((i, left[i]) for i, _ in want) and left != dict(want)

    given = rows(cut)
    single = stage(pipeline.drop_near_copies(spark, cut, str(tmp_path)), "single")
    component = brute.near_components(given, 5)
    want = [(i, t) for i, t in given if i is None or component[i] == i]
    assert by_id(went_right(single)) == by_id(want) and len(want) < len(given)

    pure = stage(pipeline.drop_leaks(spark, single, str(tmp_path)), "pure")
    given, texts = want, [t for _, t in items if t]
    want = [(i, t) for i, t in given if not brute.leaks(t, texts)]
    assert by_id(went_right(pure)) == by_id(want) and len(want) < len(given)

    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, bins = {}, {}
    for r in pipeline.pack(spark, pure, str(tmp_path)).collect():
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    count = {}
    for i, _ in want:
        count[i] = count.get(i, 0) + 1
    for i, t in want:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        got = [x for _, part in sorted(pieces[i]) for x in part]
        assert got == ids or count[i] > 1 and len(got) == count[i] * len(ids)
    assert set(pieces) == {i for i, _ in want}
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
