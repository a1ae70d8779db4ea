import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from momentlake.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/é x", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (3, "u", ""), (4, "u", "long " * 200_000), (4, "u", "long " * 200_000), (None, "u", "<p>é</p>"), (None, "n", "only")]
    warc.write_warc(_pages(spark, rows), f"{tmp_path}/w", block_bytes=100)
    for size in (64, 1 << 20):
        got = warc.read_warc(spark, f"{tmp_path}/w", split_bytes=size).collect()
        assert len(got) == len(rows)
        key = {r.record_id: r for r in got}
        assert key["<urn:page:2>"].warc_type == "response" and key["<urn:page:5>"].refers_to == "<urn:page:2>"
        assert key["<urn:page:3>"].warc_type == "response" and key["<urn:page:9>"].refers_to == "<urn:page:3>"
        assert key["<urn:page:2>"].payload.decode() == "<p>é</p>" and key["<urn:page:5>"].payload is None
        assert key["<urn:page:5>"].payload_bytes == len("<p>é</p>".encode())
        digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
        assert key["<urn:page:2>"].payload_digest == key["<urn:page:5>"].payload_digest == digest
        nulls = sorted((r.warc_type, r.refers_to or "") for r in got if r.record_id == "<urn:page:>")
        assert nulls == [("response", ""), ("revisit", "<urn:page:2>")]
        assert sum(r.record_id == "<urn:page:4>" and r.warc_type == "response" for r in got) == 2


def test_archives_are_gzip_members(spark, tmp_path):
    warc.write_warc(_pages(spark, [(i, "u", f"page {i}") for i in range(20)]), f"{tmp_path}/w")
    text = b"".join(gzip.open(f"{tmp_path}/w/{f}").read() for f in os.listdir(f"{tmp_path}/w") if f.startswith("part"))
    assert text.count(b"WARC/1.1\r\n") == 20


def test_minimum_and_empty_table(spark, tmp_path):
    warc.write_warc(_pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), f"{tmp_path}/w", min_revisit_bytes=3)
    kinds = {r.record_id: r.warc_type for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert [kinds[f"<urn:page:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]
    warc.write_warc(_pages(spark, []), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0


def test_magic_inside_a_payload_is_no_record(spark, tmp_path):
    html = "\x1f" + "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50
    warc.write_warc(_pages(spark, [(i, "u", html + str(i)) for i in range(30)]), f"{tmp_path}/w", level=0)
    got = warc.read_warc(spark, f"{tmp_path}/w", split_bytes=50)
    assert got.count() == 30 and got.select(F.count_distinct("record_id")).first()[0] == 30
