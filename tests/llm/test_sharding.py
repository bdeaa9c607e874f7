import zlib

import pytest
from pyspark.sql import functions as F

from trailweave.llm import sharding

SCHEMA = "doc_id bigint, text string, shard string, _part int, SLOT int"


def brute(rows):
    """doc_id, size, checksum, shard and slot of (doc_id, text) rows, one after the other."""
    each = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows)
    total, before, out, slots = sum(x[3] for x in each), 0, [], [0] * 16
    for known, d, crc, size in each:
        shard = (2 * before + size) * 16 // (2 * total)
        out.append((d if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def check(spark, rows, frame=None):
    got = sharding.report(frame if frame is not None else spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    said = got.collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in said), key=str) == brute(rows)
    assert all(r.law == "bytes" and r.grown_shard is None for r in said)
    return said


def test_odd_rows(spark):
    rows = [(3, "é" * 40), (3, "é" * 40), (3, "other"), (None, "no number"), (None, "no number"), (None, None), (5, None), (6, ""), (7, " \n"), (-2, "x" * 3000), (8, "y")]
    check(spark, rows)
    assert sharding.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_longer_than_a_shard_leaves_shards_empty(spark):
    said = check(spark, [(1, "a"), (2, "b" * 10_000_000), (3, "c")])
    assert {r.doc_id: r.shard for r in said} == {1: 0, 2: 8, 3: 15}


def test_sizes_differ_by_the_largest_row_at_most(spark):
    rows = [(i * 7 % 5003, "w" * (i * i % 977)) for i in range(5003)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13)
    sizes = {}
    for r in check(spark, rows, frame):
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * 977


def test_one_number_in_a_third_of_the_rows_is_dealt_to_many_partitions(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit(4).cast("bigint").alias("size"))
    out = sharding.sharded(rows, "size", ["doc_id"], 10)
    by = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.countDistinct("slot").alias("d"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("shard").collect()
    assert [(r.n, r.a, r.z, r.d) for r in by] == [(3000, 0, 2999, 3000)] * 10
    assert all(a.high <= b.low for a, b in zip(by, by[1:]))


@pytest.mark.parametrize("shards", [1, 3])
def test_written_shards_hold_whole_texts_in_order(spark, tmp_path, shards):
    rows = [(i, f"text {i} " * (i % 9), "kept") for i in range(200)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string, more string"), f"file://{tmp_path}/out", shards=shards)
    back = spark.read.parquet(f"file://{tmp_path}/out").orderBy("shard", "slot").collect()
    assert [(r.doc_id, r.text, r.more) for r in back] == rows and {r.shard for r in back} == set(range(shards))
