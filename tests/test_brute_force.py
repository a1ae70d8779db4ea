"""Queries that SQL cannot express, against plain Python on whole tables of the smallest size."""

import numpy as np
from pyspark.sql import functions as F

from momentlake.operators import anomalies, frames, search
from momentlake.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else v


def test_highlights_by_hand(spark):
    rng = np.random.default_rng(3)
    for spread, count in ((0.05, 6), (2.0, 12)):  # tight clusters: fewer than asked for are found
        x = np.concatenate([rng.normal(size=8) + spread * rng.normal(size=(60, 8)) for _ in range(4)])
        rows = [(i, v.tolist(), float(i % 50)) for i, v in enumerate(x)]
        got = anomalies.select_highlights(spark.createDataFrame(rows, "id long, embedding array<double>, score double"), count, 0.7, block=9).collect()
        order, kept = sorted(rows, key=lambda r: (-r[2], r[0])), []
        for rank, (i, v, _) in enumerate(order, 1):
            if len(kept) < count and all(_unit(np.array(v)) @ _unit(x[k]) <= 0.7 for _, k in kept):
                kept.append((rank, i))
        assert sorted((r.rank, r.id) for r in got) == kept


def test_value_at_a_place(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=500), np.ones(50), np.concatenate([np.zeros(300), rng.random(100) * 1e-9, [1e9]])):
        df = spark.createDataFrame([(float(v),) for v in x], "score double")
        for n in (0, len(x) // 2, len(x) - 1):
            assert anomalies._nth(df, "score", n, most=20) == np.sort(x)[n]


def _words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def test_text_features_by_hand(spark):
    texts = dict(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect())
    texts = {i: t for i, t in texts.items()} | {-1: "red red CAR, at night", -2: "parked bright moving", -3: ""}
    df = spark.createDataFrame([*texts.items(), (-4, None)], "query_id long, text string")
    for r in frames.text_features(df).collect():
        cube, bright, motion = np.zeros(64), np.zeros(8), np.zeros(4)
        words = _words(texts.get(r.query_id) or "")
        for w in words:
            if w in frames.COLOURS:
                a = frames.COLOURS[w]
                for i in range(64):
                    away = sum(abs(p - q) for p, q in zip(a, (i // 16, i // 4 % 4, i % 4), strict=True))
                    cube[i] += {0: 1, 1: 0.5}.get(away, 0)
        for hits, block, at in ((frames.DARK, bright, 0), (frames.BRIGHT, bright, 7), (frames.FAST, motion, 3), (frames.STILL, motion, 0)):
            if set(words) & set(hits):
                block += [{0: 1, 1: 0.5}.get(abs(i - at), 0) for i in range(len(block))]
        want = _unit(np.concatenate([_unit(cube), np.zeros(48), _unit(bright), _unit(motion)]))
        assert np.allclose(r.embedding, want, atol=1e-12)


def test_span_features_by_hand(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.encode("html", "UTF-8").alias("rgb")).collect()
    spans = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        spans.setdefault(r.page_id // 4, []).append(bytes(r.rgb or b""))
    got = {}
    for r in QUERIES["m5_span_features"](spark, SF).collect():
        got.setdefault(r.span_id, {})[r.i] = r.x
    assert set(got) == set(spans)
    for span, own in spans.items():
        hist, grid, bright, motion = np.zeros(64), np.zeros(48), np.zeros(8), np.zeros(4)
        for rgb in own:
            width, height, px = 16, max(1, len(rgb) // 48), [tuple(rgb[i : i + 3]) for i in range(0, len(rgb) // 3 * 3, 3)]
            for a, b, c in px:
                hist[a // 64 * 16 + b // 64 * 4 + c // 64] += 1
            cells = [[] for _ in range(16)]
            for i, p in enumerate(px):
                cells[min(i // width // -(-height // 4), 3) * 4 + min(i % width // -(-width // 4), 3)].append(p)
            grid += np.array([sum(p[c] for p in cell) / 255 / max(1, len(cell)) for cell in cells for c in range(3)])
            luma = sum(0.299 * a + 0.587 * b + 0.114 * c for a, b, c in px) / len(px) / 255 if px else 0
            bright[min(int(luma * 8), 7)] += 1
        for x, y in zip(own[:-1], own[1:], strict=True):
            n = min(len(x), len(y))
            moved = sum(abs(a - b) for a, b in zip(x, y, strict=False)) / n / 255 if n else 0
            motion[sum(moved >= e for e in (0.01, 0.05, 0.15))] += 1
        want = _unit(np.concatenate([_unit(hist / len(own)), _unit(grid / len(own)), _unit(bright / len(own)), _unit(motion / max(1, len(own) - 1))]))
        assert np.allclose([got[span][i] for i in range(124)], want, atol=2e-6)


def test_top_k_over_batches_with_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, size=(300, 4)).astype(float)  # most scores tie
    q = rng.integers(-1, 2, size=(40, 4)).astype(float)
    rows = [(f"c{i}", f"/{i % 7}", float(i % 3), float(i % 3 + 1), v.tolist()) for i, v in enumerate(x)]
    c = spark.createDataFrame([*rows, ("none", "/", 0.0, 1.0, None)], "id string, source_file string, start_time double, end_time double, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        for group_rows in (None, 9):
            got = {(r.query_id, r.rank): (r.id, r.score) for r in search.top_k(c, asked, 7, group_rows=group_rows).collect()}
            for i, v in enumerate(q):
                best = sorted((-float(v @ x[n]), s, a, name) for n, (name, s, a, _, _) in enumerate(rows))[:7]
                assert [got[i, k + 1] for k in range(7)] == [(b[3], -b[0]) for b in best]
            assert len(got) == 280
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(90, 3)).astype(float)
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (90, None), (91, [float("nan"), 0.0, 0.0])], "id long, embedding array<double>")
    d = 1 - x @ x.T
    for block, block_bytes, cells in ((2048, 32 << 20, 1 << 21), (8, 1 << 20, 50), (8, 400, 7)):
        monkeypatch.setattr(anomalies, "BLOCK", block)
        monkeypatch.setattr(anomalies, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(anomalies, "CELLS", cells)
        got = {(r.a, r["rank"]): (r.b, r.distance) for r in anomalies.neighbours(df, 5).collect()}
        assert len(got) == 450
        for a in range(90):
            best = sorted((d[a, b], b) for b in range(90) if b != a)[:5]
            assert [got[a, k + 1] for k in range(5)] == [(b, y) for y, b in best]
