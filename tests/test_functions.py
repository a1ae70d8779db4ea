from pyspark.sql import functions as F

from momentlake.functions import moments as M
from momentlake.functions import text as T
from momentlake.functions import vectors as V
from momentlake.sources import media


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_windows(spark):
    def spans(d):
        w = one(spark, M.fixed_windows(F.lit(d).cast("long"), 30_000, 5_000).alias("w")).w
        return [(x.start_ms, x.end_ms) for x in w]

    assert spans(10_000) == [(0, 10_000)]
    assert spans(75_000) == [(0, 30_000), (25_000, 55_000), (50_000, 75_000)]
    assert spans(30_000) == [(0, 30_000)] and spans(30_001) == [(0, 30_000), (25_000, 30_001)]
    for bad in (30_000, 40_000):
        try:
            M.fixed_windows(F.lit(100_000), 30_000, bad)
        except ValueError:
            continue
        raise AssertionError


def test_formats(spark):
    r = one(spark, *(M.format_duration(F.lit(float(x))).alias(f"d{i}") for i, x in enumerate((5, 65, 3661, -3, 59.6))), *(M.format_bytes(F.lit(x)).alias(f"b{i}") for i, x in enumerate((12, 1536, 5 << 20, 3 << 30, 2048 << 30))))
    assert tuple(r) == ("0:05", "1:05", "1:01:01", "0:00", "1:00", "12 B", "1.5 KB", "5.0 MB", "3.0 GB", "2048.0 GB")
    halves = one(spark, *(M.format_bytes(F.lit(x)).alias(f"h{i}") for i, x in enumerate((349440, 349542, 349645, 1310720, (1 << 30) * 5 // 4))))
    assert tuple(halves) == ("341.2 KB", "341.3 KB", "341.5 KB", "1.2 MB", "1.2 GB")  # a half goes to the even digit, as in C's printf
    r = one(spark, M.clip_name(F.lit("/a/my.clip.mp4"), F.lit(3.4), F.lit(75.0)).alias("n"), M.number_text(F.lit(25.0)).alias("t"), M.number_text(F.lit(2.5)).alias("u"), M.segment_id(F.lit(7)).alias("s"))
    assert tuple(r) == ("match_my.clip_00m03s-01m15s.mp4", "25", "2.5", "segment_000007")


def test_spaced_frames_are_counted_without_being_made(spark):
    rows = [(n, most, a, b) for n in (0, 1, 7, 90, 600) for most in (1, 8) for a, b in ((0.0, 1.0), (2.0, 3.5), (50.0, 60.0))]
    df = spark.createDataFrame(rows, "n int, most int, a double, b double")
    for most in (1, 8, 500):
        spaced, count = (f(F.col("n"), F.lit(25.0), most, F.col("a"), F.col("b")) for f in (M.spaced_frames, M.spaced_count))
        for r in df.select("n", "a", "b", spaced.alias("s"), count.alias("c")).collect():
            assert (r.s, r.c) == (None, None) if r.n == 0 else len(r.s) == r.c
            if r.n:
                first = min(r.n - 1, int(r.a * 25))
                last = min(r.n - 1, max(first, int(r.b * 25) - 1))
                want = min(most, last - first + 1)
                assert r.s == [int(first + i * ((last - first) / max(want - 1, 1))) for i in range(want)]


def test_overlap_and_intervals(spark):
    r = one(spark, M.overlap_ratio(*(F.lit(x) for x in (0.0, 10.0, 8.0, 30.0))).alias("a"), M.overlap_ratio(*(F.lit(x) for x in (0.0, 10.0, 10.0, 30.0))).alias("b"), M.valid_interval(F.lit(0.0), F.lit(float("inf"))).alias("c"), M.valid_interval(F.lit(2), F.lit(2)).alias("d"), M.valid_interval(F.lit(0), F.lit(1)).alias("e"))
    assert tuple(r) == (0.2, 0.0, False, False, True)


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, V.norm(a).alias("n"), V.l2_normalize(a).alias("u"), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))).alias("z"), V.cosine(a, a).alias("c"), V.is_valid(F.array(F.lit(1.0), F.lit(float("nan")))).alias("bad"), V.is_valid(F.array().cast("array<double>")).alias("none"), V.is_valid(a, 3).alias("size"), V.is_valid(F.lit(None).cast("array<double>")).alias("null"), V.is_valid(a, 2).alias("ok"))
    assert (r.n, r.u, r.z, r.bad, r.none, r.size, r.null, r.ok) == (5.0, [0.6, 0.8], 0.0, False, False, False, False, True) and abs(r.c - 1) < 1e-12


def test_searchable_text_and_rescue(spark):
    caption = '{"description": "A red car passes.", "setting": "street", "activities": ["driving"], "salient_objects": ["car", " "]}'
    r = one(spark, T.searchable_text(F.lit("scene_caption"), F.parse_json(F.lit(caption))).alias("a"), T.searchable_text(F.lit("ocr"), F.parse_json(F.lit('{"text": "Error 503"}'))).alias("b"), T.searchable_text(F.lit("other"), F.parse_json(F.lit("{}"))).alias("c"))
    assert tuple(r) == ("A red car passes · street · driving · car", "Error 503", "")
    v = T.rescued_json(F.lit('```json\nSure: {"k": 1}\n```'))
    w = T.rescued_json(F.lit("no object"))
    r = one(spark, F.to_json(v).alias("v"), F.to_json(w).alias("w"))
    assert r.v == '{"k":1}' and '"parse_fallback":true' in r.w


def test_paths(spark):
    names = ["/r/a.MP4", "/r/b.mov", "/r/x.mts", "/r/y.mp4.txt", "/r/.mp4", "/r/node_modules/c.mp4", "/r/Target/d.mkv", "/r/ok/e.webm", "/q/f.mp4", "/r/f"]
    files = spark.createDataFrame([(n, 1, 0) for n in names], "path string, length long, modified long")
    assert [r.path for r in media.media_paths(files, "/r").orderBy("path").collect()] == ["/r/a.MP4", "/r/b.mov", "/r/ok/e.webm"]
    assert media.media_paths(files, "/r/Target").count() == 1
    r = one(spark, *(T.category_of_path(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("D:/Trip/SUNSET.MP4", "my-dog.mov", "clip-001.mov"))), T.mime_of_path(F.lit("/a/b.MKV")).alias("m"), T.mime_of_path(F.lit("/a.b/c")).alias("o"))
    assert tuple(r) == ("Places", "Animals", "Unsorted", "video/x-matroska", "application/octet-stream")


def test_scan_register_and_owned(spark, tmp_path):
    (tmp_path / "lib/sub").mkdir(parents=True)
    for name, data in (("b.mp4", b"1"), ("sub/a.mov", b"1"), ("c.txt", b"2"), ("d.mkv", b"3")):
        (tmp_path / "lib" / name).write_bytes(data)
    found = media.scan_folders(spark, [str(tmp_path / "lib"), str(tmp_path / "lib/sub")]).collect()
    assert [r.file_name for r in found] == ["b.mp4", "d.mkv", "a.mov"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "lib")).select(media.plain_path(F.col("path")).alias("path"), "content")
    known = media.register(files.filter("path like '%d.mkv'"), spark.createDataFrame([], "content_hash string"))
    new = media.register(files, known)
    assert sorted(r.uri.rsplit("/", 1)[1] for r in new.collect()) == ["b.mp4", "c.txt"]
    roots = spark.createDataFrame([(str(tmp_path / "lib/sub"),), (str(tmp_path / "lib/sub/"),)], "root string")
    assert media.owned(files, roots).count() == 1
