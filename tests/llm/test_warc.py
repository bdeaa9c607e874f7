import gzip
import os
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.llm import warc

SCHEMA = "page_id bigint, url string, html string, record_type string, sha1 string"


def brute(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == payload and p is not None]
        first = min(same, default=None) if len(payload) >= least else None
        revisit = first is not None and page != first
        out.append((page, len(payload), warc.digest_of(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(3, "u", "<p>é\r\n\r\nx</p>", "c", "c"), (1, "u\r\nWARC-Type: x", "<p>é\r\n\r\nx</p>", None, "c"), (1, "v", "<p>é\r\n\r\nx</p>", "c", "c"), (4, None, None, "c", "c"), (5, "", "", "c", "c"), (None, "u", "", "c", "c"), (None, None, "alone", "c", "c"), (6, "u", "y" * 3_000_000, "c", "c"), (7, "u", "abc", "", ""), (8, "u", "abc", "", "")]
    got = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA), least).collect()]
    assert sorted(map(str, got)) == brute(rows, least)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_come_back_whole(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write(pages, f"file://{tmp_path}/w")
    back = warc.read(spark, f"file://{tmp_path}/w", range_bytes=3000).collect()
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    assert sorted(r.page_id for r in back) == sorted(html)
    by = {r.page_id: r for r in back}
    assert all(html[r.page_id] == bytes(r.payload if r.record_type == "response" else by[r.refers_to].payload) for r in back)
    assert all(r.url == u for r, u in ((by[p.page_id], p.url) for p in pages.collect()))


def test_every_record_has_one_owner(tmp_path):
    r = random.Random(6)
    data = []
    for i in range(40):
        payload = bytes(r.choice((31, 139, 8, 0, 65)) for _ in range(r.randrange(400)))
        if i % 3 == 0:  # a stored member holds its payload, and so false magic numbers and even whole gzip members
            packer = zlib.compressobj(0, zlib.DEFLATED, 31)
            block = b"HTTP/1.1 200 OK\r\n\r\n" + payload + gzip.compress(b"no record") + warc.MAGIC
            data.append(packer.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(block)) + block + b"\r\n\r\n") + packer.flush())
        else:
            data.append(warc.record(i, "u", payload, "response", None, warc.digest_of(payload)))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(data))
    size = path.stat().st_size
    for step in (1, 7, 100, 1000, size):
        seen = []
        for at in range(0, size, step):
            with pa.OSFile(os.fspath(path)) as f:
                seen += [warc.parsed(m)[0] for m in warc.members(f, at, min(at + step, size))]
        assert seen == [*range(40)], step


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    duckdb.sql(f"create or replace view pages as from '{path}'")
    want = sorted(map(str, duckdb.sql(warc.ORACLE).fetchall()))
    assert sorted(str(tuple(r)) for r in warc.round_trip(spark.read.parquet(path)).collect()) == want


def test_long_heads_foreign_and_damaged_records(spark, tmp_path):
    def member(head, block=b"HTTP/1.1 200 OK\r\n\r\nbody"):
        return gzip.compress(b"WARC/1.0\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n")

    good = warc.record(1, "u", b"first", "response", None, warc.digest_of(b"first"))
    long = member(b"WARC-Target-URI: x:" + random.Random(1).randbytes(300_000).hex().encode() + b"\r\nWARC-Type: response\r\nContent-Length: 23")
    rest = [member(b"warc-type: warcinfo"), member(b"WARC-Type: response"), member(b"WARC-Type: response\r\nContent-Length: many"), member(b"WARC-Type: response\r\nContent-Length: 4", b"none")]
    (tmp_path / "a.warc.gz").write_bytes(good + long + b"".join(rest))
    rows = warc.read(spark, f"file://{tmp_path}", range_bytes=1000).collect()
    assert [(r.record_type, r.payload and bytes(r.payload)) for r in rows] == [("response", b"first"), ("response", b"body"), ("warcinfo", None), ("response", b"body"), ("response", b"body"), ("response", b"none")]
    broken = bytearray(long)
    broken[len(broken) // 2] ^= 255
    (tmp_path / "a.warc.gz").write_bytes(good + bytes(broken) + good + good[:-5])
    for ranges in (100, 1 << 20):
        read = lambda mode, ranges=ranges: warc.read(spark, f"file://{tmp_path}", range_bytes=ranges, mode=mode)
        assert [r.page_id for r in read("DROPMALFORMED").collect()] == [1, 1]
        damaged = [r.payload_bytes for r in read("PERMISSIVE").collect() if r.record_type == "damaged"]
        assert len(damaged) == 2 and all(damaged)
        with pytest.raises(Exception, match="no whole WARC record"):
            read("FAILFAST").collect()


def test_many_repeated_payloads(spark):
    pages = spark.range(60_000).selectExpr("id as page_id", "'u' as url", "concat('page ', id div 2) as html")
    got = warc.round_trip(pages).groupBy("record_type").agg(F.count("*"), F.sum((F.col("refers_to") == F.col("page_id") - 1).cast("int")))
    assert sorted(map(tuple, got.collect())) == [("response", 30_000, None), ("revisit", 30_000, 30_000)]


def test_numbers_of_nineteen_digits(spark):
    most, least = (1 << 63) - 1, -(1 << 63)
    rows = [(1234567890123456789, "u", "same", "", ""), (1234567890123456790, "u", "same", "", ""), (most, "u", "a", "", ""), (least, "u", "b", "", ""), (most - 1, "u", "b", "", "")]
    assert sorted(map(str, map(tuple, warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()))) == brute(rows)


def test_what_is_added_stays_and_what_is_overwritten_goes(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    page = lambda i: spark.createDataFrame([(i, "u", f"page {i}")], "page_id bigint, url string, html string")
    ids = lambda: sorted(r.page_id for r in warc.read(spark, path).collect())
    for i in (1, 2, 3):
        warc.write(page(i), path)
    assert ids() == [1, 2, 3]
    warc.as_records(page(4)).write.format("warc").mode("overwrite").save(path)
    assert ids() == [4] and len([f for f in os.listdir(tmp_path / "archives") if f.endswith(".gz")]) == 1
    warc.write(page(5), path)
    assert ids() == [4, 5]
